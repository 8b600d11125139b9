"""Bytes of a text file to text: encoding, line ending, lossy decoding."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.runtime import ship

SAMPLE_BYTES, HEAD_BYTES = 128 << 10, 4 << 10
CANDIDATES = ("utf-8", "big5", "gb18030")


def _is_cjk(c: str) -> bool:
    return "\u4e00" <= c <= "\u9fff" or "\u3400" <= c <= "\u4dbf" or "\u3000" <= c <= "\u303f" or "\uff00" <= c <= "\uffef"


def _is_noise(c: str) -> bool:
    return c == "\ufffd" or "\ue000" <= c <= "\uf8ff" or c < " " and c not in "\t\r\n\f" or "\x7f" <= c <= "\x9f"


def wide_without_mark(data: bytes) -> str | None:
    """utf-16-le or utf-16-be where NUL bytes say so, else None."""
    head = data[:HEAD_BYTES]
    if head.count(0) * 200 < len(head) or len(head) < 2:
        return None
    even, odd = head[::2].count(0), head[1::2].count(0)
    breaks = {name: head.decode(name, "ignore").count("\n") for name in ("utf-16-le", "utf-16-be")}
    if bool(breaks["utf-16-le"]) != bool(breaks["utf-16-be"]):
        return max(breaks, key=breaks.get)
    if odd >= 8 * max(even, 1):
        return "utf-16-le"
    return "utf-16-be" if even >= 8 * max(odd, 1) else None


def detected(data: bytes) -> str:
    """Codec of a file by its first SAMPLE_BYTES: byte-order mark, UTF-16 by its NULs,
    strict UTF-8 (a character may be cut at the end), else the codec with most Chinese
    characters and least noise."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return name
    sample = data[:SAMPLE_BYTES]
    wide = wide_without_mark(sample)
    if wide:
        return wide
    reader = codecs.getincrementaldecoder("utf-8")()
    try:
        reader.decode(sample, final=len(data) <= len(sample))
        return "utf-8"
    except UnicodeDecodeError:
        pass

    def score(name: str) -> float:
        text = sample.decode(name, "replace")
        n = max(1, len(text))
        return 100 * sum(map(_is_cjk, text)) / n - 400 * sum(map(_is_noise, text)) / n

    return max(CANDIDATES, key=score)


def line_ending(content: Column) -> Column:
    """CRLF or LF, by the whole content."""
    return F.when(F.contains(content, F.lit(b"\r\n")), "CRLF").otherwise("LF")


def decoded(files: DataFrame, encoding: str | None = None) -> DataFrame:
    """files (with binary `content`) with text, encoding and n_damaged: replacement
    characters where the codec fails."""
    ship(files.sparkSession)

    @F.pandas_udf("text string, encoding string, n_damaged long")
    def decode(content: pd.Series) -> pd.DataFrame:
        out = []
        for data in content:
            data = bytes(data or b"")
            name = encoding or detected(data)
            text = data.decode(name, "replace")
            out.append((text.removeprefix("\ufeff"), name, text.count("\ufffd")))
        return pd.DataFrame(out, columns=["text", "encoding", "n_damaged"])

    return files.withColumn("_d", decode("content")).select(*files.columns, "_d.text", "_d.encoding", "_d.n_damaged")
