"""Contents against a loop over single documents, with one scripted model behind both."""

import json
import random

import pytest
from pyspark.sql import functions as F

from arbograph.functions import models
from arbograph.graph import DocumentGraph
from arbograph.operators import contents, structure
from arbograph.plans import indexing

CHECK, RECENT, MAX_TOKENS = 6, 3, 60


def scripted():
    """A model that is sent by value, with a method for each kind of question."""
    import json
    import re

    from arbograph.functions import models
    from arbograph.operators import contents

    class Model:
        def detect(self, text):
            return "yes" if "CONTENTS" in text else "who knows" if "UNCLEAR" in text else None if "DOWN" in text else "no"

        def numbered(self, content):
            return "NUMBERED" in content

        def transform(self, content):
            """Lines like ``1.2|Title|7`` or ``1.2|Title|``."""
            rows = re.findall(r"([\d.]+)\|(\w+)\|(\d*);", content)
            return None if "BROKEN" in content else [{"structure": s, "title": t, "page": int(p) if p else None} for s, t, p in rows]

        def pages(self, text):
            return [(int(a), b) for a, b in re.findall(r"(?s)<physical_index_(\d+)>\n(.*?)\n<physical_index_\1>", text)]

        def mentioned(self, title, text):
            """The first page that names the title, be it only in passing."""
            return next((p for p, body in self.pages(text) if title in body), None)

        def located(self, title, text):
            return next((p for p, body in self.pages(text) if f"={title}=" in body), None)

        def fill(self, entries, text):
            if "GARBLED" in text:
                return None
            tag = lambda e: self.mentioned(e["title"], text)
            return [e | ({"physical_index": f"<physical_index_{tag(e)}>"} if tag(e) and not e.get("physical_index") else {}) for e in entries]

        def listed(self, carried, text):
            """New headings, numbered on from the last entry that is shown; the number of those shown goes into the titles' numbers, too."""
            if "FAILING" in text:
                raise OSError("no answer")
            n = int(carried[-1]["structure"].split(".")[0]) if carried else 0
            found = [(p, t) for p, body in self.pages(text) for t in re.findall(r"=(\w+)=", body)]
            return [{"structure": f"{n + k}.{len(carried)}", "title": t, "physical_index": f"<physical_index_{p}>"} for k, (p, t) in enumerate(found, 1)]

        def chat(self, prompt):
            task, *parts = prompt.split("\n\n")
            rest = "\n\n".join(parts)
            if contents.DETECT == task:
                if self.detect(rest) is None:
                    raise models.ModelError("down")
                return json.dumps({"toc_detected": self.detect(rest)})
            if contents.NUMBERED == task:
                return "```json\n" + json.dumps({"page_index_given_in_toc": "yes" if self.numbered(rest) else "no"}) + "\n```"
            if contents.TRANSFORM == task:
                whole = json.dumps({"table_of_contents": self.transform(rest)})
                if "LONG" not in rest:
                    return whole
                at = len(parts[2]) if len(parts) > 2 else 0
                return models.Reply(whole[at : at + 90], at + 90 >= len(whole))
            if contents.PLACE == task:
                found = [(e, self.mentioned(e["title"], rest)) for e in json.loads(parts[0])]
                return json.dumps([e | {"physical_index": f"<physical_index_{p}>"} for e, p in found if p])
            if contents.FILL == task:
                told = self.fill(json.loads(parts[0]), rest)
                return "I cannot." if told is None else json.dumps(told)
            if contents.BEGIN == task:
                return json.dumps(self.listed([], rest))
            if contents.CONTINUE == task:
                return json.dumps(self.listed(json.loads(parts[0]), rest))
            if contents.APPEARS == task:
                return json.dumps({"answer": "Yes" if f"={parts[0]}=" in rest else "no"})
            if contents.STARTS == task:
                return json.dumps({"start_begin": "yes" if "\n\n".join(parts[1:]).startswith(f"={parts[0]}=") else "no"})
            if contents.LOCATE == task:
                p = self.located(parts[0], rest)
                return json.dumps({"physical_index": f"<physical_index_{p}>" if p else None})
            raise ValueError(task)

    return Model()


# the loop over one document

def tagged(pages, a, b):
    return "".join(f"<physical_index_{p}>\n{pages[p - 1]}\n<physical_index_{p}>\n" for p in range(max(a, 1), min(b, len(pages)) + 1))


def printed_table(m, pages):
    start, kept = 1, None
    while True:
        run, at, inside = [], start, False
        while at <= len(pages) and (at <= CHECK or inside):
            said = m.detect(pages[at - 1])
            if said == "yes":
                run.append(at)
                inside = True
            elif said == "no" and inside:
                break
            at += 1
        if not run:
            return kept
        content = "".join(pages[p - 1] for p in run)
        if m.numbered(content):
            return content, run[-1]
        if run[-1] + 1 > CHECK:
            return kept
        start = run[-1] + 1


def numbers(m, pages, content, last):
    rows = m.transform(content) or []
    text = tagged(pages, last + 1, last + CHECK)
    places = [(r["title"], m.mentioned(r["title"], text)) for r in rows]
    diffs = [q - r["page"] for r in rows for t, q in places if t == r["title"] and q and q >= last and r["page"] is not None]
    if not diffs:
        return []
    offset = max(dict.fromkeys(diffs), key=diffs.count)
    out = [r | {"physical_index": r["page"] + offset if r["page"] is not None else None} for r in rows]
    for k, r in enumerate(out):
        if r["physical_index"] is None:
            before = next((x["physical_index"] for x in out[k - 1 :: -1] if x["physical_index"]), 0) if k else 0
            after = next((x["physical_index"] for x in out[k + 1 :] if x["page"] is not None), -1)
            r["physical_index"] = m.located(r["title"], tagged(pages, before, after))
    return out


def groups_of(pages):
    tokens = [-(-len(p) // 4) for p in pages]
    return [tagged(pages, a + 1, b + 1) for a, b in structure.group_pages(tokens, MAX_TOKENS, 1)]


def number(tag):
    return int(tag.split("_")[-1].rstrip(">")) if tag else None


def titles(m, pages, content):
    rows = [{"structure": r["structure"], "title": r["title"], "physical_index": None} for r in m.transform(content) or []]
    for text in groups_of(pages) if rows else ():
        rows = m.fill(rows, text) or rows
    return [r | {"physical_index": number(r["physical_index"])} for r in rows]


def text_alone(m, pages):
    rows = []
    for text in groups_of(pages):
        try:
            rows += m.listed(rows[-RECENT:], text)
        except OSError:
            break
    return [r | {"physical_index": number(r["physical_index"])} for r in rows]


def one_document(m, pages):
    table = printed_table(m, pages)
    way = structure.WAYS[0] if table else structure.WAYS[2]
    decisions = []
    while True:
        rows = numbers(m, pages, *table) if way == structure.WAYS[0] else titles(m, pages, table[0]) if way == structure.WAYS[1] else text_alone(m, pages)
        rows = [r for r in rows if r["physical_index"] is not None and 1 <= r["physical_index"] <= len(pages)]
        right = lambda r, p: f"={r['title']}=" in pages[p - 1]
        accuracy = 0.0
        if rows and rows[-1]["physical_index"] >= len(pages) / 2:
            for r in rows:
                r["correct"] = right(r, r["physical_index"])
            accuracy = sum(r["correct"] for r in rows) / len(rows)
        if accuracy == 1:
            decisions.append((way, accuracy, "accept"))
            break
        if accuracy > 0.6:
            decisions.append((way, accuracy, "fix"))
            for _ in range(3):
                found = []
                for k, r in enumerate(rows):
                    if not r["correct"]:
                        before = next((x["physical_index"] for x in rows[k - 1 :: -1] if x["correct"]), 0) if k else 0
                        after = next((x["physical_index"] for x in rows[k + 1 :] if x["correct"]), len(pages))
                        p = m.located(r["title"], tagged(pages, before, after))
                        if p and right(r, p):
                            found.append((r, p))
                for r, p in found:
                    r |= {"physical_index": p, "correct": True}
            break
        following = {structure.WAYS[0]: structure.WAYS[1], structure.WAYS[1]: structure.WAYS[2]}.get(way, "failed")
        decisions.append((way, accuracy, following))
        if following == "failed":
            return [(str(p), f"Page {p}", p, None) for p in range(1, len(pages) + 1)], decisions
        way = following
    return [(r["structure"], r["title"], r["physical_index"], r["correct"]) for r in rows], decisions


def document(rng):
    """Pages with headings ``=Title=``, some named in passing elsewhere, behind a table that may be right, wrong or missing."""
    front = [""] * rng.choice((0, 0, 1, 2))
    names = [f"T{k}x" for k in range(rng.randint(2, 9))]
    body = [""] * rng.randint(len(names), 3 * len(names))
    at = sorted(rng.sample(range(len(body)), len(names)))
    for name, p in zip(names, at):
        body[p] = rng.choice((f"={name}= text", f"before ={name}= text")) + " word" * rng.randint(0, 20)
    for _ in range(rng.choice((0, 0, 1, 4))):
        body[rng.randrange(len(body))] += " see " + rng.choice(names)
    mark = rng.choice(("", "", "", "GARBLED", "FAILING"))
    body[rng.randrange(len(body))] += mark
    shift = rng.choice((0, 0, 3))
    if rng.random() < 0.3:  # numbers of another edition
        at = [p + rng.randint(-4, 9) for p in at]
    entries = "".join(f"{k + 1}|{n}|{p + shift + rng.choice((0, 0, 0, 1)) if rng.random() < 0.8 and p >= 0 else ''};" for k, (n, p) in enumerate(zip(names, at)) if rng.random() < 0.9)
    if rng.random() < 0.2:
        entries = "".join(f"{k}|{rng.choice(names)}|{rng.randint(0, 3)};" for k in range(4))
    kind = rng.choice(("NUMBERED", "NUMBERED", "NUMBERED LONG", "", "BROKEN NUMBERED", None, "TWO"))
    if kind is None:
        table = []
    elif kind == "TWO":
        table = ["CONTENTS of figures", "", f"CONTENTS NUMBERED {entries}"]
    else:
        half = len(entries) // 2 if rng.random() < 0.3 else 0
        table = [f"CONTENTS {kind} {entries[:half]}", *([rng.choice(("UNCLEAR", "DOWN"))] if half and rng.random() < 0.5 else []), f"CONTENTS {entries[half:]}"] if half else [f"CONTENTS {kind} {entries}"]
    return [*front, *table, *body]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    docs = {k: document(rng) for k in range(120)}
    rows = [(d, p, t, -(-len(t) // 4)) for d, pages in docs.items() for p, t in enumerate(pages, 1)]
    return docs, spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, page_no int, text string, tokens long").repartition(3)


def test_documents_end_as_in_a_loop_over_each(corpus):
    docs, pages = corpus
    found = contents.verified_contents(pages, scripted(), MAX_TOKENS, CHECK, RECENT)
    entries, decisions = {d: [] for d in docs}, {d: [] for d in docs}
    for r in found.entries.orderBy("doc_id", "ord").collect():
        entries[r.doc_id].append((r.structure, r.title, r.physical_index, r.correct))
    for r in found.decisions.collect():
        decisions[r.doc_id].append((r.way, r.accuracy, r.decision))
    seen = set()
    for d, text in docs.items():
        rows, way = one_document(scripted(), text)
        assert sorted(decisions[d]) == sorted(way), d
        assert entries[d] == rows, d
        seen |= {(w, k) for w, _, k in way}
    first, second, third = structure.WAYS
    assert seen >= {(first, "accept"), (first, "fix"), (first, second), (second, "fix"), (second, third), (third, "accept"), (third, "failed")}, seen


def test_a_wave_shows_the_last_entries_of_the_wave_before(spark):
    text = [f"=A{k}x= " + "word " * 50 for k in range(9)]
    rows = [(d, k + 1, t, -(-len(t) // 4)) for d, n in ((1, 9), (2, 4), (3, 1)) for k, t in enumerate(text[:n])]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string, tokens long")
    found = contents.carried_contents(pages, scripted(), MAX_TOKENS, RECENT).orderBy("doc_id", "ord").collect()
    for d, n in ((1, 9), (2, 4), (3, 1)):
        alone = text_alone(scripted(), text[:n])
        assert [(r.structure, r.title, r.physical_index) for r in found if r.doc_id == d] == [(r["structure"], r["title"], r["physical_index"]) for r in alone]
    assert max(int(r.structure.split(".")[1]) for r in found) == RECENT


def test_nothing_to_ask_about(spark):
    pages = spark.createDataFrame([], "doc_id long, page_no int, text string, tokens long")
    found = contents.verified_contents(pages, scripted())
    assert found.entries.count() == 0 and found.decisions.count() == 0
    plain = spark.createDataFrame([(1, 1, None, 0), (1, 2, "", 0)], "doc_id long, page_no int, text string, tokens long")
    assert [(r.title, r.correct) for r in contents.verified_contents(plain, scripted()).entries.orderBy("ord").collect()] == [("Page 1", None), ("Page 2", None)]


def test_sections_that_start_their_page(spark):
    pages = spark.createDataFrame([(1, 1, "=A= x =B="), (1, 2, "y")], "doc_id long, page_no int, text string")
    entries = spark.createDataFrame([(1, 1, "A", 1), (1, 2, "B", 1), (1, 3, "C", None), (1, 4, "D", 9)], "doc_id long, ord int, title string, physical_index int")
    assert [r.appear_start for r in contents.starting_pages(entries, pages, scripted()).orderBy("ord").collect()] == ["yes", "no", "no", "no"]


def test_indexing_with_checked_contents(spark):
    docs = spark.createDataFrame([("p.pdf", None, 1)], "doc_name string, doc_group string, doc_version int")
    text = ["CONTENTS NUMBERED 1|Ax|1;2|Bx|3;", "intro", "=Ax= a", "more", "=Bx= b"]
    pages = spark.createDataFrame([("p.pdf", k, t, 5) for k, t in enumerate(text, 1)], "doc_name string, page_no int, text string, tokens long")
    none = lambda s: s.select("section_id", "title", "title", "title").toDF("section_id", "name", "type", "relevance").filter("false")
    g = indexing.index_pages(DocumentGraph(spark), docs, pages, none, Relating(), verify=True, summarise=models.FirstSentence())
    rows = [(r.title, r.start_index, r.end_index, bool(r.summary)) for r in g["sections"].orderBy("node_id").collect()]
    assert rows == [("Preface", 1, 2, True), ("Ax", 3, 4, True), ("Bx", 5, 5, True)]


def Relating():
    model = scripted()

    class Both:
        def chat(self, prompt):
            return "[]" if prompt.startswith("Name relationships") else model.chat(prompt)

    return Both()


def test_answers_that_end_by_length_go_on(spark):
    class Slow:
        def chat(self, prompt):
            from arbograph.functions import models

            first, *more = prompt.split("\n\n")
            if first == "down":
                raise OSError("gone")
            done = len(more[-1]) if more else 0
            if first == "breaks" and done:
                raise models.ModelError("late")
            return models.Reply(str(done // 2 % 10) * 2, first != "endless" and done >= int(first[1:] or 0) if first[0] == "n" else first != "endless" and first != "breaks")

    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(("n0", "n4", "down", "breaks", "endless", None))], "id long, t string")
    found = {r.id: (r.answer, r.status, r.calls) for r in models.long_replies(rows, F.col("t"), Slow(), 3).collect()}
    assert found == {0: ("00", "finished", 1), 1: ("001122", "finished", 3), 2: (None, "failed", 1), 3: ("00", "failed", 2), 4: ("00112233", "length", 4), 5: (None, "failed", 1)}
    reasons = {r.id: r.reason for r in models.replies(rows, F.col("t"), Slow()).collect()}
    assert reasons[2] == "OSError: gone" and reasons[5] == "no prompt" and reasons[0] is None

    class Wrong:
        def chat(self, prompt):
            return {}["a programming error"]

    with pytest.raises(Exception, match="programming"):
        models.answers(rows, F.col("t"), Wrong()).collect()


def test_scripted_tables_are_json():
    assert json.loads(scripted().chat(f"{contents.TRANSFORM}\n\n1|Ax|2;"))["table_of_contents"][0]["page"] == 2


def test_long_runs_of_contents_pages_take_few_rounds(spark, monkeypatch):
    def said(d, k):
        return {1: "yes" if k <= 250 else "no", 2: "no" if k < 4 else "yes", 3: ("no", "yes", "unclear")[k % 3], 4: "no"}[d]

    rounds, store = [], contents.materialise
    monkeypatch.setattr(contents, "materialise", lambda rows, name: (rounds.append(name), store(rows, name))[1])
    last = {1: 300, 2: 60, 3: 40, 4: 30}
    pages = spark.createDataFrame([(d, k, said(d, k)) for d in last for k in range(1, last[d] + 1)], "doc_id long, page_no int, text string")

    class Reader:
        def chat(self, prompt):
            return json.dumps({"toc_detected": prompt.rsplit("\n\n", 1)[1]})

    starts = pages.select("doc_id").distinct().withColumn("start", F.lit(1))
    found = {(r.doc_id, r.page_no) for r in contents.contents_pages(pages, starts, Reader()).collect()}
    assert found == {(1, k) for k in range(1, 251)} | {(2, k) for k in range(4, 61)} | {(3, 1)}
    assert rounds.count("detected") <= 10
