"""Secret scan: an Aho-Corasick keyword pass, anchored patterns only at its hits, then embedded checksums.

One automaton holds the keywords of all kinds; a pattern is tried only where a keyword of its kind begins. Runs of hex
digits have no keyword and are found by their own pattern. Tokens that carry a checksum (the last six characters are the
base-62 CRC32 of the thirty before them) count only if it holds.

Spans are code points, end exclusive, by start and then kind in the order of KINDS. Per kind they don't overlap and are
taken from the left; a match that fails its length or checksum still uses up its characters.

Edge cases: null or empty text has no spans; rows are independent, so repeated rows give repeated results; extra columns
are ignored by scan() and kept by redact(), whatever their names; a null doc_id stays null; texts are scanned whole
whatever their length; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import partial

from arterial.llm.common import bound_batches, quiet_worker

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "checked_token", "slack_token", "google_key", "live_key", "signed_token", "private_key")
_VALUE = re.ASCII
# kind: (keywords in lower case, pattern anchored at the keyword)
RULES = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"),
               re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _VALUE)),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+", _VALUE)),
    "checked_token": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])", _VALUE)),
    "slack_token": (("xoxb-", "xoxp-", "xoxa-", "xoxs-"), re.compile(r"xox[bpas]-[0-9A-Za-z-]{20,}", _VALUE)),
    "google_key": (("aiza",), re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])", _VALUE)),
    "live_key": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[0-9A-Za-z]{24,}", _VALUE)),
    "signed_token": (("eyj",), re.compile(r"eyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}", _VALUE)),
    "private_key": (("-----begin",), re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", _VALUE)),
}
_HEX = re.compile(r"[0-9a-f]{24,}")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FOLD = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def checksum_holds(body: str) -> bool:
    """Whether the last six of 36 characters are the base-62 CRC32 of the first thirty."""
    n, out = zlib.crc32(body[:30].encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out == body[30:]


def _passes(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return m.end() - m.start() >= 20
    return checksum_holds(m[1]) if kind == "checked_token" else True


class Scanner:
    def __init__(self):
        quiet_worker()
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, (words, _) in RULES.items():
            for w in words:
                self.automaton.add_word(w, (kind, len(w) - 1))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        folded = text.lower()
        if len(folded) != len(text):  # some letters grow when lowered; places must stay
            folded = text.translate(_FOLD)
        hits: dict[str, list[int]] = {}
        for end, (kind, back) in self.automaton.iter(folded):
            hits.setdefault(kind, []).append(end - back)
        found = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
        for kind, places in hits.items():
            match, over = RULES[kind][1].match, 0
            for at in sorted(places):
                if at >= over and (m := match(text, at)):
                    over = m.end()
                    if _passes(kind, m):
                        found.append((at, over, kind))
        order = {k: i for i, k in enumerate(KINDS)}
        return sorted(found, key=lambda s: (s[0], order[s[2]]))


def _told(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(batches):
    import pyarrow as pa

    scanner = Scanner()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for text in batch.column(1):
            spans = scanner.spans(text.as_py() or "")
            base = [s for s in spans if s[2] in BASE]
            for k, kind in enumerate(BASE):
                out[k].append(sum(s[2] == kind for s in base))
            out[3].append(hashlib.sha256(_told(base).encode()).hexdigest())
            out[4].append(_told(spans))
            out[5].append(len(spans))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names)


def scan(docs, id_col: str = "doc_id", text_col: str = "text"):
    """One row per document with its counts and spans."""
    bound_batches(docs.sparkSession)
    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_scan, SCHEMA)


def redacted(text: str, spans, mark: str = "[{kind}]") -> str:
    """The text with every span, or union of overlapping ones, replaced by a mark of its first kind."""
    out, at, k = [], 0, 0
    while k < len(spans):
        a, b, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][1])
            k += 1
        out += [text[at:a], mark.format(kind=kind)]
        at = b
    return "".join([*out, text[at:]])


def _redact(batches, text_col: str, length_col: str | None):
    import pyarrow as pa

    scanner = Scanner()
    for batch in batches:
        names = batch.schema.names
        at = names.index(text_col)
        texts = batch.column(at).to_pylist()
        new = [t if not t or not (s := scanner.spans(t)) else redacted(t, s) for t in texts]
        cols = list(batch.columns)
        cols[at] = pa.array(new, cols[at].type)
        if length_col in names:
            k = names.index(length_col)
            old = cols[k].to_pylist()
            cols[k] = pa.array([o if n == t else len(n) for o, n, t in zip(old, new, texts, strict=True)], cols[k].type)
        yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)


def redact(docs, text_col: str = "text", length_col: str | None = "n_chars"):
    """docs with the secrets in text_col replaced by marks, and length_col (if there) brought up to date."""
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(partial(_redact, text_col=text_col, length_col=length_col), docs.schema)
