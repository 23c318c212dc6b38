"""Text functions that need Unicode tables the JVM functions lack, over Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Punctuation left out of title keys.
_TITLE_MARKS = re.compile("[‐‑‒–—―ー_\\-・･:：!！?？'\"“”‘’()（）\\[\\]【】]")
_SPACE = re.compile(r"\s+")


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """A text in Unicode's compatibility form (NFKC)."""
    return text.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def title_key(text: pd.Series) -> pd.Series:
    """A title without case, width, space and punctuation; null is empty."""
    return text.fillna("").map(lambda t: _TITLE_MARKS.sub("", _SPACE.sub("", unicodedata.normalize("NFKC", t).casefold())))


@F.pandas_udf(StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """The lower-case ASCII letters and digits of a text, accents taken off."""

    def fold(t: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return "".join(c.lower() for c in plain if c.isascii() and c.isalnum())

    return text.map(fold, na_action="ignore")


@F.pandas_udf(StringType())
def decode_any(content: pd.Series) -> pd.Series:
    """Bytes as text: by the first of several encodings that fits, else UTF-8 with replacements."""

    def read(data: bytes) -> str:
        for code in ("utf-8-sig", "shift_jis", "euc_jp", "gb18030", "cp949"):
            try:
                return bytes(data).decode(code)
            except UnicodeError:
                continue
        return bytes(data).decode("utf-8", "replace")

    return content.map(read, na_action="ignore")


@F.pandas_udf(StringType())
def join_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """A link's address on its page, without fragment, its path's blanks and non-ASCII characters escaped; null of a null side."""
    from urllib.parse import quote, urldefrag, urljoin, urlsplit, urlunsplit

    def whole(b: str | None, h: str | None) -> str | None:
        if b is None or h is None:
            return None
        parts = urlsplit(urldefrag(urljoin(b, h.strip()))[0])
        return urlunsplit(parts._replace(path=quote(parts.path, safe="/%:@!$&'()*+,;=~-._")))

    return pd.Series([whole(b, h) for b, h in zip(base, href)], dtype=object)
