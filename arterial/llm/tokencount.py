"""Token counts by section: offset-mapped attribution.

Each document is encoded once. The character spans of its tokens are joined with the intervals of its sections (both are
sorted, so a binary search joins them), and each token counts for exactly one section. Sections are the text's lines,
each with its line feed, or the given fields of a record laid end to end.

A token that crosses a boundary goes, by `rule`: 'first' to the section where it begins, 'last' to the one where it
ends, 'most' to the one that holds most of its characters (of equals the first). Section counts always add up to the
document's count.

Edge cases: null or empty text is one empty section without tokens; repeated rows are counted each; a null doc_id stays
null; a text of any length is encoded whole; a token that no section holds a character of counts where it stands; extra
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np

from arterial.llm.common import bound_batches
from arterial.llm.tokens import OffsetEncoder, encoder, tokenizer_path

SCHEMA = "doc_id long, section int, name string, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"
RULES = ("first", "last", "most")


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str):
    """(section of each token, whether it crosses); bounds: n + 1 ascending positions of n sections."""
    inner = bounds[1:-1]
    a = np.searchsorted(inner, starts, "right")
    b = np.maximum(np.searchsorted(inner, np.maximum(ends - 1, starts), "right"), a)
    crossing = b > a
    if rule == "first" or not crossing.any():
        return a, crossing
    if rule == "last":
        return b, crossing
    out = a.copy()
    for k in np.flatnonzero(crossing):
        edges = np.clip(bounds[a[k] : b[k] + 2], starts[k], ends[k])
        out[k] = a[k] + int(np.argmax(np.diff(edges)))
    return out, crossing


def line_bounds(text: str) -> np.ndarray:
    at = [0]
    found = text.find("\n")
    while found >= 0 and found + 1 < len(text):
        at.append(found + 1)
        found = text.find("\n", found + 1)
    return np.array([*at, len(text)])


def _counts(batches, tokenizer: str, rule: str, fields: tuple[str, ...]):
    import pyarrow as pa

    codec = encoder(OffsetEncoder, tokenizer)
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for first in range(0, len(keys), 128):
            cols = [c[first : first + 128].to_pylist() for c in batch.columns[1:]]
            records = [[x or "" for x in r] for r in zip(*cols, strict=True)]
            texts = ["".join(r) for r in records]
            out: list[list] = [[] for _ in range(8)]
            for key, record, text, (a, b) in zip(keys[first : first + 128], records, texts, codec.spans(texts), strict=True):
                bounds = line_bounds(text) if not fields else np.concatenate(([0], np.cumsum([len(x) for x in record])))
                n = len(bounds) - 1
                section, crossing = attribute(a, b, bounds, rule)
                out[0] += [key] * n
                out[1] += range(n)
                out[2] += fields or ["line"] * n
                out[3] += bounds[:-1].tolist()
                out[4] += bounds[1:].tolist()
                out[5] += np.bincount(section, minlength=n).tolist()
                out[6] += np.bincount(section[crossing], minlength=n).tolist()
                out[7] += [len(a)] * n
            kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def count_tokens(docs, id_col: str = "doc_id", text_col: str = "text", fields: tuple[str, ...] = (), rule: str = "most", tokenizer: str | None = None):
    """One row per section with the tokens allotted to it. fields: columns laid end to end in place of text_col's lines."""
    bound_batches(docs.sparkSession)
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    from pyspark.sql import functions as F

    columns = [F.col(c).cast("string") for c in (fields or (text_col,))]
    run = partial(_counts, tokenizer=tokenizer or tokenizer_path("byte_bpe_50k.json"), rule=rule, fields=tuple(fields))
    return docs.select(F.col(id_col).cast("long"), *columns).mapInArrow(run, SCHEMA)
