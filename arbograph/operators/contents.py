"""Contents of paged documents, asked for and checked: a state machine over batches of documents.

Contents come by one of three ways, each of which follows the one before where that
fails: the printed table with its page numbers, the printed titles looked for in the
text, or the sections that the text itself shows.  What a way finds is checked entry
by entry; contents that are right stand, those that are right but for a few entries
are fixed in at most ``FIXES`` rounds, others go on to the next way, and documents
that no way serves get a section a page.  Every step works on all documents that have
come to it, is stored, and leaves out those that are done; what each document went
through is a table of decisions.

Steps whose prompts need the answers before them are waves: round k has the k-th
part of every document that is still open, so a document's parts never run out of
order and documents never wait for each other's number of parts.

Defined results: a model that fails, or answers something else, says nothing: pages
are no contents, entries aren't found and checks aren't passed; documents without
pages have no contents; entries beyond the last page are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbograph.functions import models
from arbograph.functions.text import physical_index, repaired_json, without_dot_leaders
from arbograph.operators import structure
from arbograph.operators.prompts import prompt
from arbograph.operators.structure import WAYS
from arbograph.session import materialise

#: Pages among which contents begin, and of the text in which their entries are looked for.
CHECK_PAGES = 20
#: Pages that one round asks for.
WAVE_PAGES = 5
#: Open documents whose ids are sent to the tasks, so that only their pages are dealt out, at most.
SENT_DOCUMENTS = 100_000
#: Entries that a later part of a document is shown.
RECENT = 10
#: Rounds in which wrong entries are asked for again.
FIXES = 3

DETECT = "Is there a table of contents in the text? Lists of figures or tables, abstracts and notations are none. Answer as JSON with the key toc_detected, yes or no."
NUMBERED = "Are there page numbers in the table of contents? Answer as JSON with the key page_index_given_in_toc, yes or no."
TRANSFORM = "Turn the whole table of contents into JSON with the key table_of_contents, an array of objects with structure (like 1.2, or null), title and page (a number, or null)."
PLACE = "Add the pages to the table of contents: a JSON array of its entries that start in the pages below, as objects with structure, title and physical_index (the tag of the page)."
FILL = "For each entry of the structure that starts in the text below set physical_index to the tag of its page, and keep the others as they are. Answer with the whole structure as a JSON array of objects with structure, title and physical_index."
BEGIN = "List the sections of the text as a JSON array of objects with structure (like 1.2), title and physical_index (the tag of the page where it starts)."
CONTINUE = "Go on with the list of sections, of which the last are given, for the text below: a JSON array of the new ones only, as objects with structure, title and physical_index (the tag of the page where it starts)."
APPEARS = "Does the section appear or start on the page? Take no notice of blanks. Answer as JSON with the key answer, yes or no."
STARTS = "Does the section start at the beginning of the page, with nothing before its title? Take no notice of blanks. Answer as JSON with the key start_begin, yes or no."
LOCATE = "On which of the pages does the section start? Answer as JSON with the key physical_index, the tag of the page."

_ENTRY = "struct<structure:string,title:string,physical_index:string>"


def _word(answer: Column, key: str) -> Column:
    return F.lower(F.trim(F.get_json_object(repaired_json(answer), f"$.{key}")))


def _entries(answer: Column, kind: str = _ENTRY) -> Column:
    """The objects of a JSON array, those that aren't objects left out; null if it is no array."""
    items = F.from_json(repaired_json(answer), "array<string>")
    return F.filter(F.transform(items, lambda x: F.from_json(x, kind)), lambda x: x.isNotNull() & x["title"].isNotNull())


def _ask(rows: DataFrame, client: models.Client, task: str, *parts: Column) -> DataFrame:
    return models.replies(rows, prompt(task, *parts), client)


def _page_of(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """``rows`` with the text of their page_no."""
    return rows.join(pages.select("doc_id", "page_no", "text"), ["doc_id", "page_no"], "left")


def contents_pages(pages: DataFrame, starts: DataFrame, client: models.Client, check_pages: int = CHECK_PAGES, wave: int = WAVE_PAGES) -> DataFrame:
    """(doc_id, page_no) of the first run of contents pages from ``starts`` (doc_id, start) on.

    The run begins on one of the first ``check_pages`` pages and ends before the
    first page that is said to be none; pages of which nothing is said don't end
    it.  A round asks for the next ``wave`` pages of the documents whose run isn't
    at its end, or for as many as the run has so far, so few rounds meet long runs
    and at most as many pages are asked for in vain.
    """
    last = pages.groupBy("doc_id").agg(F.max("page_no").cast("int").alias("last"))
    state = starts.join(last, "doc_id").select("doc_id", F.col("start").cast("int").alias("at"), F.lit(None).cast("int").alias("first"), "last")
    found = None
    while True:
        end = F.least(F.col("at") + F.greatest(F.lit(wave), F.col("at") - F.col("first")) - 1, F.col("last"), F.when(F.col("first").isNull(), check_pages).otherwise(F.col("last")))
        state = state.withColumn("end", end.cast("int")).filter("at <= end")
        begin, stop, n = state.agg(F.min("at"), F.max("end"), F.count("*")).first()
        if begin is None:
            return found if found is not None else pages.select("doc_id", "page_no").filter("false")
        held = pages.filter(F.col("page_no").between(begin, stop))  # other pages aren't dealt out
        if n <= SENT_DOCUMENTS:
            held = held.join(F.broadcast(state.select("doc_id")), "doc_id", "left_semi")
        asked = _page_of(state.withColumn("page_no", F.explode(F.sequence("at", "end"))), held)
        told = _ask(asked, client, DETECT, F.coalesce("text", F.lit("")))
        told = materialise(told.select("doc_id", "page_no", "first", "end", "last", _word(F.col("answer"), "toc_detected").alias("said")), "detected")
        first = F.coalesce(F.first("first"), F.min(F.when(F.col("said") == "yes", F.col("page_no"))))
        by_doc = told.groupBy("doc_id").agg(first.cast("int").alias("first"), F.first("end").alias("end"), F.first("last").alias("last"))
        ends = told.drop("first", "end", "last").join(by_doc, "doc_id").filter("said = 'no' and page_no > first").groupBy("doc_id").agg(F.min("page_no").alias("stop"))
        state = materialise(by_doc.join(ends, "doc_id", "left"), "runs")
        run = told.select("doc_id", "page_no", "said").join(state, "doc_id").filter("said = 'yes' and page_no >= first and (stop is null or page_no < stop)").select("doc_id", "page_no")
        found = run if found is None else found.unionByName(run)
        state = state.filter("stop is null").select("doc_id", (F.col("end") + 1).alias("at"), "first", "last")


def contents_texts(pages: DataFrame, client: models.Client, check_pages: int = CHECK_PAGES) -> DataFrame:
    """doc_id, content, last_page and numbered of the documents with a printed table of contents.

    Where the first table has no page numbers, further ones are looked for behind
    it, while they would begin on the first ``check_pages`` pages; the first that has some counts.
    """
    state = pages.select("doc_id").distinct().withColumn("start", F.lit(1))
    done = None
    while True:
        listed = contents_pages(pages, state, client, check_pages)
        texts = listed.join(pages.select("doc_id", "page_no", "text"), ["doc_id", "page_no"]).groupBy("doc_id").agg(
            without_dot_leaders(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "")).alias("content"),
            F.max("page_no").alias("last_page"),
        )
        told = _ask(texts, client, NUMBERED, F.col("content"))
        told = materialise(told.select("doc_id", "content", "last_page", (F.coalesce(_word(F.col("answer"), "page_index_given_in_toc"), F.lit("")) == "yes").alias("numbered")), "tables")
        # a first table stands for the document until one with numbers is found
        done = told if done is None else done.unionByName(told.filter("numbered"))
        state = told.filter("not numbered and last_page < " + str(int(check_pages))).select("doc_id", (F.col("last_page") + 1).alias("start"))
        if state.isEmpty():
            break
    best = F.max_by(F.struct("content", "last_page", "numbered"), F.col("numbered").cast("int"))
    return done.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.*")


def printed_entries(tables: DataFrame, client: models.Client) -> DataFrame:
    """doc_id, ord, structure, title and page of the printed tables; answers that end by length go on."""
    told = models.long_replies(tables.select("doc_id", "content"), prompt(TRANSFORM, F.col("content")), client)
    listed = F.get_json_object(repaired_json(F.col("answer")), "$.table_of_contents")
    rows = told.filter(F.col("status") == models.FINISHED).select("doc_id", F.posexplode(_entries(listed, "struct<structure:string,title:string,page:string>")).alias("ord", "e"))
    return materialise(rows.select("doc_id", "ord", "e.structure", "e.title", F.col("e.page").try_cast("int").alias("page")), "printed")


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    """doc_id and the rows of each document as one JSON array, in order."""
    return rows.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*columns).alias("e")))), lambda x: x["e"])).alias("entries"))


def by_page_numbers(pages: DataFrame, printed: DataFrame, tables: DataFrame, client: models.Client, check_pages: int = CHECK_PAGES) -> DataFrame:
    """Entries whose page is the printed one and the commonest difference from it of entries found in the text behind the table.

    Entries without a printed page are asked for one after the other, each within
    the pages between its neighbours that have one.
    """
    total = structure.document_totals(pages)
    behind = tables.join(total, "doc_id").select("doc_id", F.lit(0).alias("ord"), (F.col("last_page") + 1).alias("start_index"), F.least(F.col("last_page") + check_pages, F.col("total_pages")).cast("int").alias("end_index"))
    shown = _listed(printed, "structure", "title").join(structure.labelled_text(behind, pages).select("doc_id", "text"), "doc_id")
    told = _ask(shown, client, PLACE, F.col("entries"), F.col("text"))
    placed = told.select("doc_id", F.explode(_entries(F.col("answer"))).alias("e")).select("doc_id", "e.title", physical_index(F.col("e.physical_index")).alias("physical_index"))
    placed = placed.join(tables.select("doc_id", "last_page"), "doc_id").filter(F.col("physical_index") >= F.col("last_page"))
    pairs = structure.toc_matching_pairs(printed, placed).filter("page is not null")
    entries = structure.with_offset(printed, structure.page_offset(pairs))
    return _fill_gaps(materialise(entries.select("doc_id", "ord", "structure", "title", F.col("physical_index").cast("int").alias("physical_index")), "entries"), pages, client)


def _fill_gaps(entries: DataFrame, pages: DataFrame, client: models.Client) -> DataFrame:
    missing = F.col("physical_index").isNull()
    order = Window.partitionBy("doc_id").orderBy("ord")
    gap = F.sum((~missing).cast("int")).over(order)
    marked = entries.withColumn("gap", gap)
    turns = materialise(marked.filter(missing).select("doc_id", "ord", F.row_number().over(Window.partitionBy("doc_id", "gap").orderBy("ord")).alias("turn")), "gaps")
    for turn in range(1, (turns.agg(F.max("turn")).first()[0] or 0) + 1):
        bounds = structure.toc_gap_bounds(entries).join(turns.filter(F.col("turn") == turn).select("doc_id", "ord"), ["doc_id", "ord"])
        spans = bounds.select("doc_id", "ord", "title", F.greatest("before", F.lit(1)).alias("start_index"), F.col("after").alias("end_index"))
        shown = spans.join(structure.labelled_text(spans, pages), ["doc_id", "ord"])
        told = _ask(shown, client, LOCATE, F.col("title"), F.col("text")).select("doc_id", "ord", physical_index(_word(F.col("answer"), "physical_index")).alias("now"))
        entries = materialise(entries.join(told, ["doc_id", "ord"], "left").withColumn("physical_index", F.coalesce("physical_index", "now")).drop("now"), "entries")
    return entries


def grouped_texts(pages: DataFrame, max_tokens: int) -> DataFrame:
    """doc_id, group_no and the tagged text of each group of pages."""
    groups = structure.page_groups(pages, max_tokens)
    spans = groups.select("doc_id", F.col("group_no").alias("ord"), F.col("first_page").alias("start_index"), F.col("last_page").alias("end_index"))
    return materialise(structure.labelled_text(spans, pages).withColumnRenamed("ord", "group_no"), "groups")


def _waves(groups: DataFrame) -> range:
    last = groups.agg(F.max("group_no")).first()[0]
    return range(0 if last is None else last + 1)


def by_titles(pages: DataFrame, printed: DataFrame, client: models.Client, max_tokens: int = 20_000) -> DataFrame:
    """Printed entries whose pages are filled in group by group; each group sees what those before it have found.

    An answer that can't be read leaves the entries as they were.
    """
    groups = grouped_texts(pages, max_tokens)
    kind = f"array<{_ENTRY}>"
    state = printed.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("structure", "title", F.lit(None).cast("string").alias("physical_index")).alias("e")))), lambda x: x["e"]).cast(kind).alias("entries"))
    for k in _waves(groups):
        shown = state.join(groups.filter(F.col("group_no") == k).select("doc_id", "text"), "doc_id")
        told = _ask(shown, client, FILL, F.to_json("entries", {"ignoreNullFields": "false"}), F.col("text"))
        now = told.select("doc_id", _entries(F.col("answer")).alias("now"))
        state = materialise(state.join(now, "doc_id", "left").select("doc_id", F.coalesce("now", "entries").alias("entries")), "filled")
    rows = state.select("doc_id", F.posexplode("entries").alias("ord", "e"))
    return rows.select("doc_id", "ord", "e.structure", "e.title", physical_index(F.col("e.physical_index")).alias("physical_index"))


def carried_contents(pages: DataFrame, client: models.Client, max_tokens: int = 20_000, recent: int = RECENT) -> DataFrame:
    """Entries that the text shows, group by group; each group is shown the last ``recent`` entries before it.

    A group that fails, or whose answer ends by length too often, ends its document's list; an answer that can't be read adds nothing.
    """
    groups = grouped_texts(pages, max_tokens)
    found, carried = None, None
    for k in _waves(groups):
        part = groups.filter(F.col("group_no") == k)
        if carried is None:
            asked = part.withColumn("carried", F.array().cast(f"array<{_ENTRY}>"))
            text = prompt(BEGIN, F.col("text"))
        else:
            asked = part.join(carried, "doc_id")
            text = prompt(CONTINUE, F.to_json("carried"), F.col("text"))
        told = models.long_replies(asked, text, client).filter(F.col("status") == models.FINISHED)
        read = F.coalesce(_entries(F.col("answer")), F.array().cast(f"array<{_ENTRY}>"))
        told = materialise(told.select("doc_id", "group_no", "carried", read.alias("entries")), "wave")
        more = told.select("doc_id", "group_no", F.posexplode("entries").alias("k", "e"))
        found = more if found is None else found.unionByName(more)
        both = F.concat("carried", "entries")
        carried = told.select("doc_id", F.slice(both, F.greatest(F.size(both) - recent, F.lit(0)) + 1, recent).alias("carried"))
    if found is None:
        return pages.sparkSession.createDataFrame([], "doc_id long, ord int, structure string, title string, physical_index int")
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("group_no", "k")) - 1
    return found.select("doc_id", ord_.cast("int").alias("ord"), "e.structure", "e.title", physical_index(F.col("e.physical_index")).alias("physical_index"))


def checked(entries: DataFrame, pages: DataFrame, client: models.Client) -> DataFrame:
    """``entries`` (doc_id, ord, title, physical_index) with ``correct``: whether the title is on its page."""
    shown = _page_of(entries.withColumn("page_no", F.col("physical_index")), pages)
    told = _ask(shown, client, APPEARS, F.col("title"), F.col("text"))
    return told.select(*entries.columns, (F.coalesce(_word(F.col("answer"), "answer"), F.lit("")) == "yes").alias("correct"))


def verified(entries: DataFrame, pages: DataFrame, client: models.Client) -> tuple[DataFrame, DataFrame]:
    """The entries that were checked, and doc_id and accuracy of every document that has entries.

    Contents whose last entry lies in the first half of the document aren't checked; their accuracy is 0.
    """
    totals = structure.document_totals(pages).select("doc_id", "total_pages")
    last = entries.groupBy("doc_id").agg(F.max_by("physical_index", "ord").alias("last_index")).join(totals, "doc_id")
    far = last.filter(F.col("last_index") >= F.col("total_pages") / 2).select("doc_id")
    found = materialise(checked(entries.join(far, "doc_id", "left_semi"), pages, client), "checked")
    accuracy = last.select("doc_id").join(structure.toc_accuracy(found), "doc_id", "left")
    return found, accuracy.select("doc_id", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def fixed(entries: DataFrame, pages: DataFrame, client: models.Client, rounds: int = FIXES) -> DataFrame:
    """``entries`` (with correct) whose wrong ones are asked for again between the right ones around them, and checked again.

    What is still wrong after ``rounds`` keeps its page.  Each round has the wrong entries of all documents.
    """
    totals = structure.document_totals(pages).select("doc_id", "total_pages")
    columns = ["doc_id", "ord", "structure", "title", "physical_index", "correct"]
    entries = entries.select(*columns)
    for _ in range(rounds):
        right = F.when(F.col("correct"), F.col("physical_index"))
        order = Window.partitionBy("doc_id").orderBy("ord")
        before = F.last(right, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first(right, True).over(order.rowsBetween(1, Window.unboundedFollowing))
        wrong = entries.withColumns({"before": before, "after": after}).filter("not correct").join(totals, "doc_id")
        if wrong.isEmpty():
            break
        spans = wrong.select("doc_id", "ord", "structure", "title", "total_pages", F.greatest(F.coalesce("before", F.lit(0)), F.lit(1)).cast("int").alias("start_index"), F.least(F.coalesce("after", F.col("total_pages")), F.col("total_pages")).cast("int").alias("end_index"))
        shown = spans.join(structure.labelled_text(spans, pages), ["doc_id", "ord"])
        told = _ask(shown, client, LOCATE, F.col("title"), F.col("text"))
        told = told.select("doc_id", "ord", "title", "total_pages", physical_index(_word(F.col("answer"), "physical_index")).alias("physical_index"))
        again = checked(told.filter("physical_index between 1 and total_pages").drop("total_pages"), pages, client).filter("correct")
        again = again.select("doc_id", "ord", F.col("physical_index").alias("now"))
        joined = entries.join(again, ["doc_id", "ord"], "left")
        entries = materialise(joined.select("doc_id", "ord", "structure", "title", F.coalesce("now", "physical_index").alias("physical_index"), (F.col("correct") | F.col("now").isNotNull()).alias("correct")), "fixed")
    return entries


@dataclass(frozen=True)
class Contents:
    """entries (doc_id, ord, structure, title, physical_index, correct; null where nothing was checked) and decisions (doc_id, way, accuracy, decision)."""

    entries: DataFrame
    decisions: DataFrame


def verified_contents(pages: DataFrame, client: models.Client, max_tokens: int = 20_000, check_pages: int = CHECK_PAGES, recent: int = RECENT) -> Contents:
    """Contents of every document of ``pages`` (doc_id, page_no from 1, text, tokens)."""
    tables = materialise(contents_texts(pages, client, check_pages).filter("numbered"), "tables")
    state = pages.select("doc_id").distinct().join(tables.select("doc_id", F.lit(WAYS[0]).alias("way")), "doc_id", "left").select("doc_id", F.coalesce("way", F.lit(WAYS[2])).alias("way"))
    state = materialise(state, "state")
    totals = structure.document_totals(pages)
    printed = printed_entries(tables, client)
    entries, decisions, failed = None, None, None
    for way in WAYS:
        open_ = state.filter(F.col("way") == way).select("doc_id")
        mine = pages.join(open_, "doc_id", "left_semi")
        own = lambda df: df.join(open_, "doc_id", "left_semi")  # noqa: E731, B023
        if open_.isEmpty():
            continue
        if way == WAYS[0]:
            found = by_page_numbers(mine, printed, tables, client, check_pages)
        elif way == WAYS[1]:
            found = by_titles(mine, own(printed), client, max_tokens)
        else:
            found = carried_contents(mine, client, max_tokens, recent)
        found = structure.toc_validate(found, totals).filter("physical_index >= 1")
        found = materialise(found.select("doc_id", "ord", "structure", "title", "physical_index"), "found")
        looked, accuracy = verified(found, mine, client)
        accuracy = open_.join(accuracy, "doc_id", "left").select("doc_id", F.lit(way).alias("way"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))
        decided = materialise(accuracy.withColumn("decision", structure.toc_decision(F.col("accuracy"), F.col("way"))), "decisions")
        taken = lambda what: looked.join(decided.filter(F.col("decision") == what).select("doc_id"), "doc_id", "left_semi")  # noqa: E731, B023
        columns = ["doc_id", "ord", "structure", "title", "physical_index", "correct"]
        done = materialise(taken("accept").select(*columns).unionByName(fixed(taken("fix"), mine, client)), "contents")
        entries = done if entries is None else entries.unionByName(done)
        decisions = decided if decisions is None else decisions.unionByName(decided)
        following = decided.filter(F.col("decision").isin(*WAYS)).select("doc_id", F.col("decision").alias("way"))
        state = state.filter(F.col("way") != way).unionByName(following)
        failed = decided.filter("decision = 'failed'").select("doc_id")
    if entries is None:
        none = pages.sparkSession.createDataFrame([], "doc_id long, ord int, structure string, title string, physical_index int, correct boolean")
        return Contents(none, pages.sparkSession.createDataFrame([], "doc_id long, way string, accuracy double, decision string"))
    if failed is not None:
        plain = structure.fallback_structure(pages.join(failed, "doc_id", "left_semi"))
        plain = plain.select("doc_id", F.col("ord").cast("int").alias("ord"), F.col("ord").cast("string").alias("structure"), "title", F.col("start_index").cast("int").alias("physical_index"), F.lit(None).cast("boolean").alias("correct"))
        entries = entries.unionByName(plain)
    return Contents(entries, decisions)


def starting_pages(entries: DataFrame, pages: DataFrame, client: models.Client) -> DataFrame:
    """``entries`` with appear_start: whether the section is the first thing on its page, yes or no."""
    shown = _page_of(entries.withColumn("page_no", F.col("physical_index")), pages)
    text = F.when(F.col("physical_index").isNotNull() & F.col("text").isNotNull(), prompt(STARTS, F.col("title"), F.col("text")))
    told = models.replies(shown, text, client)
    return told.select(*entries.columns, F.when(_word(F.col("answer"), "start_begin") == "yes", "yes").otherwise("no").alias("appear_start"))
