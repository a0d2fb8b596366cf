"""Fields of a case page.

Case pages close their tags badly, so fields are read with the standard library's tolerant parser in an Arrow
UDF: for each wanted element the text up to its end tag. Short pages of fixed form can be read by regular expression
instead (``pattern_field``), which stays in the JVM.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tag, attribute and value of each field's element.
ELEMENTS = {
    "initial_date": ("div", "id", "dataHoraDistribuicaoProcesso"), "class_type": ("span", "id", "classeProcesso"), "subject": ("span", "id", "assuntoProcesso"),
    "value": ("div", "id", "valorAcaoProcesso"), "last_movement": ("td", "class", "dataMovimentacao"), "status": ("span", "id", "labelSituacaoProcesso"), "party": ("td", "class", "nomeParteEAdvogado"),
}
RECORD = ("initial_date", "class_type", "subject", "value", "last_movement", "status", "plaintiff", "defendant")
FIELDS = T.StructType([T.StructField(f, T.StringType()) for f in RECORD])


class _Reader(HTMLParser):
    """Texts of the wanted elements, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: dict[str, list[str]] = {k: [] for k in ELEMENTS}
        self.open: list[list] = []  # field, tag, depth, texts

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for item in self.open:
            item[2] += item[1] == tag
        have = dict(attrs)
        for field, (kind, attribute, value) in ELEMENTS.items():
            if tag == kind and value in (have.get(attribute) or "").split():
                self.open.append([field, tag, 1, []])

    def handle_endtag(self, tag: str) -> None:
        for item in self.open:
            item[2] -= item[1] == tag
        for item in [x for x in self.open if not x[2]]:
            self.open.remove(item)
            self.found[item[0]].append("".join(item[3]).strip())

    def handle_data(self, data: str) -> None:
        for item in self.open:
            item[3].append(data)

    def close(self) -> None:
        super().close()
        for item in self.open:
            self.found[item[0]].append("".join(item[3]).strip())


def read_page(html: str | None) -> dict[str, str | None]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    out: dict[str, str | None] = {k: next(iter(v), None) for k, v in reader.found.items() if k != "party"}
    parties = [p.partition("\n")[0] for p in reader.found["party"]]
    out["plaintiff"], out["defendant"] = parties[:2] if len(parties) > 1 else (None, None)
    return out


@F.pandas_udf(FIELDS)
def page_fields(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(x) for x in html], columns=list(RECORD), dtype=object)


def pattern_field(html: Column, tag: str, attribute: str = "", value: str = "") -> Column:
    """The text of the first such element if it holds no other tag, else null."""
    mark = rf"""[^>]*\b{attribute}=["']?{re.escape(value)}\b[^>]*""" if attribute else "[^>]*"
    found = F.regexp_extract(html, rf"(?is)<{tag}\b{mark}>\s*([^<]*?)\s*</{tag}>", 1)
    return F.when(found != "", found)
