"""Secret scans by assignment-aware lexing.

Base spans come from three patterns. The method adds to them: a text that mentions a sensitive word is parsed into
name-literal pairs (see ``lexing``), constants are propagated, and each literal is scored by the words of the name it
ends up in and by its own make-up; the places of literals at ``THRESHOLD`` or above are spans of kind ``named``. So a
constant with a harmless name counts once a sensitive name takes its value, wherever it stands, and a literal in parts
counts with all of them.

Each row is worked on by itself where it is read; nothing is shuffled. Null texts count as empty. Rows with null or
repeated doc_ids give a row each. Empty tables give no rows. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as X
from .lexing import Pair, pairs

#: The kinds of spans, in their order.
KINDS = ("assign", "access", "hex", "named")
THRESHOLD = 0.5
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A pair can only count where one of these stands.
_HINT = re.compile(r"pass|pwd|secret|token|key|cred|auth|private|bearer|sign|cookie|session|salt|://", re.I | re.A)

# Words of names, fixed values.
STRONG = {"password", "passwd", "passphrase", "pwd", "passcode", "secret", "secrets", "token", "apikey", "credential", "credentials",
          "privatekey", "accesskey", "secretkey", "authtoken", "bearer"}
STRONG_BEFORE_KEY = {"api", "access", "private", "secret", "auth", "encryption", "signing", "master", "account", "service"}
WEAK = {"auth", "authorization", "key", "pass", "salt", "signature", "session", "cookie", "cred", "creds", "pin"}
#: A name that ends in one of these is about the secret, it does not hold it.
ABOUT = {"name", "id", "hint", "label", "length", "len", "size", "count", "type", "field", "file", "path", "dir", "url", "uri", "policy", "regex",
         "pattern", "expires", "expiry", "ttl", "header", "prompt", "placeholder", "column", "public", "format", "env", "title", "message"}
_STANDS_FOR = re.compile(r"(?:[x*.\-_#]+|change.?me|example.*|placeholder|password|passwd|secret|token|test(?:ing)?|todo|none|null|nil|true|false|"
                         r"undefined|default|required|optional|string|redacted|your[-_ ].*|my[-_ ].*|<.*>|\$.*|\{\{.*|%.*%|\[.*\])", re.I | re.S)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_weight(name: str) -> float:
    """How likely what a name holds is secret, by its words (camel case, underscores, dots and hyphens divide)."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words:
        return 0.0
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    keyed = any(b in {"key", "keys"} and a in STRONG_BEFORE_KEY for a, b in zip(words, words[1:], strict=False))
    weight = 1.0 if keyed or joined & STRONG or STRONG & set(words) else 0.6 if WEAK & set(words) else 0.0
    return weight * (0.2 if words[-1] in ABOUT or "public" in words else 1.0)


def literal_weight(text: str) -> float:
    """How much a literal looks like a secret: length, kinds of characters, bits a character; 0 for stand-ins."""
    if len(text) < 6 or _STANDS_FOR.fullmatch(text.strip()):
        return 0.0
    bits = -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())
    kinds = sum(bool(re.search(k, text)) for k in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    spoken = 0.4 if re.search(r"\s", text.strip()) else 1.0
    return min(1.0, 0.1 * kinds + 0.2 * bits) * spoken


def pair_score(pair: Pair) -> float:
    return name_weight(pair.name) * literal_weight(pair.text)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def named_spans(text: str, threshold: float = THRESHOLD) -> dict[tuple[int, int], float]:
    """Places of literals with the best score of the pairs they belong to."""
    out: dict[tuple[int, int], float] = {}
    if not _HINT.search(text):
        return out
    for pair in pairs(text, name_weight):
        score = pair_score(pair)
        if score >= threshold:
            for span in pair.spans:
                out[span] = max(out.get(span, 0.0), score)
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind, then end."""
    order = sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def _scanned(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _ = X.text_bytes(batch.column(1))
            for a, b in X.slices(at):
                rows = []
                for value in batch.column(1).slice(a, b - a):
                    text = value.as_py() or ""
                    base, named = base_spans(text), named_spans(text, threshold)
                    n = Counter(k for k, _, _ in base)
                    rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(),
                                 joined(base + [("named", s, e) for s, e in named]), len(named), max(named.values(), default=0.0)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=_NAMES)
    return work


_NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named", "top_score"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_named, top_score), one row per row of ``docs``."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("t"))
    return rows.mapInArrow(_scanned(threshold), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                                                "spans string, n_named long, top_score double")


def _found(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                for pair in pairs(text, name_weight) if _HINT.search(text) else []:
                    if (score := pair_score(pair)) >= threshold:
                        rows.append((doc_id, pair.name, pair.text, [list(s) for s in pair.spans], pair.hops, score))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.int32(), pa.float64())
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "name", "literal", "places", "hops", "score"])
    return work


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, name, literal, places, hops, score): every name-literal pair at the threshold, with the literal itself."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("t"))
    return rows.mapInArrow(_found(threshold), "doc_id long, name string, literal string, places array<array<long>>, hops int, score double")
