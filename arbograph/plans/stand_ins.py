"""Deterministic clients for queries over tables: they answer by rules that SQL can state."""

from __future__ import annotations

import json
import re

from arbograph.operators import contents

_PAGE = re.compile(r"(?s)<physical_index_(\d+)>\n(.*?)\n<physical_index_\1>")


class ForgetfulTitles:
    """Names each section of a prompt by its title but forgets place 3, says place 1 twice and invents place 99; alone, by its text."""

    def chat(self, prompt: str) -> str:
        task, body = prompt.split("\n\n", 1)
        if "section_index" not in task:
            return json.dumps([{"name": body, "type": "METRIC"}])
        rows = json.loads(body)
        named = [(r["section_index"], r["title"]) for r in rows if r["section_index"] != 3]
        named = [(1, "first answer") for k, _ in named if k == 1] + named + [(99, "invented")]
        return json.dumps([{"section_index": k, "entities": [{"name": t, "type": "CONCEPT", "relevance": "DISCUSSES"}]} for k, t in named])


class PageReader:
    """Finds titles, "Part " aside, by their letters, takes pages for contents by their lengths, and lists a section a page, numbered on."""

    def chat(self, prompt: str) -> str:
        task, *parts = prompt.split("\n\n")
        rest = "\n\n".join(parts)
        if task == contents.DETECT:
            return json.dumps({"toc_detected": ("yes", "no", "unclear")[len(rest) % 3]})
        if task == contents.APPEARS:
            return json.dumps({"answer": "yes" if parts[0].removeprefix("Part ") in parts[1] else "no"})
        if task == contents.LOCATE:
            found = [n for n, text in _PAGE.findall(rest) if parts[0].removeprefix("Part ") in text]
            return json.dumps({"physical_index": f"<physical_index_{found[0]}>" if found else None})
        shown = json.loads(parts[0]) if task == contents.CONTINUE else []
        number = int(shown[-1]["structure"]) if shown else 0
        return json.dumps([{"structure": str(number + k), "title": text[:12], "physical_index": n} for k, (n, text) in enumerate(_PAGE.findall(rest), 1)])
