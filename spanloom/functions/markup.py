"""Text of HTML. A parser is needed, so this is a pandas UDF."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden and data:
            if self.found and self.last == self.getpos():
                self.found[-1] += data
            else:
                self.found.append(data)
            self.last = self.getpos()


def plain_text(html: str | None) -> str | None:
    """The text nodes joined by line breaks; scripts, styles and comments are no text."""
    if html is None or "<" not in html and "&" not in html:
        return html
    p = _Text()
    p.feed(html)
    p.close()
    return "\n".join(p.found)


@F.pandas_udf(T.StringType())
def text_of_html(s: pd.Series) -> pd.Series:
    return s.map(plain_text, na_action="ignore")
