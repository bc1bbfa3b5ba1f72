"""Main-content extraction from raw HTML.

Two forms:

* :func:`extract_main_text` -- tree semantics: inside every container element
  (tag + optional exact ``class`` value), each ``h1, h2, h3, li, p`` element in
  document order contributes its *full descendant text*, so text of nested
  selected elements repeats (an unclosed ``<p>`` nests the following ones, as
  a lenient tree builder does).  A container inside a container gives its own
  text once more, after the outer one's.  Code of scripts, styles, templates
  and ruby annotations is no text.  Runs as an Arrow UDF with the
  standard-library tokenizer; a page without a container gives null instead
  of failing the job.
* :func:`extract_main_text_flat` -- native (JVM) approximation for flat pages:
  the container is cut at every selected tag and each piece's text is kept
  once.  Oracle-checkable; not equal to the tree form on nested markup.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship this module's code with the UDF (workers need not have the package).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SELECTED = ("h1", "h2", "h3", "li", "p")
# Elements that never have content (no end tag expected).
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link",
                  "meta", "param", "source", "track", "wbr"))


# Elements whose text is not part of the enclosing element's text.
SILENT = frozenset(("script", "style", "template", "rt", "rp"))


class _MainText(HTMLParser):
    def __init__(self, container: str, container_class: str | None):
        super().__init__(convert_charrefs=True)
        self.container, self.cclass = container, container_class
        self.stack: list[list] = []        # [tag, is_container, selected_buf or None]
        self.open: list[list] = []         # buffers of each open container
        self.silent = 0
        self.blocks: list[list[list[str]]] = []  # per container, in page order: element buffers

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        buf = None
        if self.open and tag in SELECTED:
            buf = []
            for elements in self.open:
                elements.append(buf)
        is_cont = tag == self.container and (self.cclass is None or dict(attrs).get("class") == self.cclass)
        if is_cont:
            self.open.append([])
            self.blocks.append(self.open[-1])
        self.silent += tag in SILENT
        self.stack.append([tag, is_cont, buf])

    def handle_startendtag(self, tag, attrs):
        pass  # self-closing: no text

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                for t, is_cont, _b in self.stack[i:]:
                    if is_cont:
                        self.open.pop()
                    self.silent -= t in SILENT
                del self.stack[i:]
                return
        # unmatched end tag: ignored

    def handle_data(self, data):
        if self.silent or not self.open:
            return
        for _t, _c, buf in self.stack:
            if buf is not None:
                buf.append(data)


def main_text(html: str | None, container: str = "main",
              container_class: str | None = "flex flex-1 flex-col") -> str | None:
    """Plain-Python extraction for one page (used inside the Arrow UDF)."""
    if html is None:
        return None
    p = _MainText(container, container_class)
    p.feed(html)
    p.close()
    if not p.blocks:
        return None
    texts = [" ".join("".join(b).replace("\n", " ").replace("\t", "") for b in blk)
             for blk in p.blocks]
    return " ".join(texts)


def extract_main_text(html: Column | str, container: str = "main",
                      container_class: str | None = "flex flex-1 flex-col") -> Column:
    @F.arrow_udf("string")
    def _extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # pages stay in Arrow's buffer and become Python strings one at a time
        for pages in batches:
            yield pa.array((main_text(h.as_py(), container, container_class) for h in pages), pa.string())
            pa.default_memory_pool().release_unused()

    return _extract(F.col(html) if isinstance(html, str) else html)


# ----------------------------------------------------------- native form
_TAG = r"<[^>]*>"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def container_pattern(container: str) -> str:
    return "(?s)<" + container + r"\b[^>]*>(.*?)</" + container + ">"


BLOCK_SPLIT = r"(?i)</?(?:h1|h2|h3|li|p)\b[^>]*>"


def _decode(c: Column) -> Column:
    for ent, ch in _ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def extract_main_text_flat(html: Column | str, container: str = "main") -> Column:
    h = F.col(html) if isinstance(html, str) else html
    conts = F.regexp_extract_all(h, F.lit(container_pattern(container)), 1)

    def flat(cont):
        pieces = F.transform(F.split(cont, BLOCK_SPLIT, -1), lambda p: _decode(F.trim(
            F.replace(F.replace(F.regexp_replace(p, _TAG, ""), F.lit("\n"), F.lit(" ")),
                      F.lit("\t"), F.lit("")))))
        return F.array_join(F.filter(pieces, lambda x: x != ""), " ")

    return F.when(F.size(conts) > 0, F.array_join(F.transform(conts, flat), " "))
