"""Secret scans: fixed patterns, and assignments read by a small lexer.

The lexer cuts a text into names, string literals, numbers, bare values, operators and line
ends as source and configuration files have them. A name followed by =, :, := or => and a
literal is a pair; a name assigned from another name takes over its literal (constants
propagate, through string concatenation with + too). A literal is a secret if the score of its
target names and of its own characters reaches a threshold; literals joined by + are also scored
as the value they add up to, and all of them are secrets if it reaches the threshold.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantwell.llm.common import blocks, documents, text_column

#: Kinds in the order in which equal starts are listed; `literal` is the lexer's.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

#: Weights of words within a target name.
NAME_WEIGHTS = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "key": 1.5,
    "credential": 2.5, "credentials": 2.5, "auth": 1.5, "private": 1.5, "access": 1.0, "signature": 1.0, "salt": 1.0, "bearer": 2.0, "api": 1.0,
}
#: Words that make a name harmless: what it holds is about a secret, not one.
NAME_RELIEF = {"id": 1.0, "name": 2.0, "path": 2.0, "file": 2.0, "url": 2.0, "length": 3.0, "count": 3.0, "type": 2.0, "expires": 2.0, "public": 2.0}
#: Values that stand for a secret to be filled in.
PLACEHOLDERS = {"password", "secret", "changeme", "example", "placeholder", "none", "null", "true", "false", "undefined", "todo", "xxxxxxxx"}
THRESHOLD = 3.5
LITERAL_LEAST = 8

_LEX = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z_$][A-Za-z0-9_$]*)*)|(?P<op>:=|=>|==|!=|<=|>=|[=:+])|(?P<end>[\n;,{}])|(?P<value>[A-Za-z0-9+/_.=@!#%^&*~-]+)|(?P<gap>[\x20\t]+)""",
    re.S,
)
#: A name ends in a word of this weight at least, its parts joined, if no part is a word itself.
JOINED_LEAST = 2.5
#: Lines with an assignment sign are lexed, unless no name on them can score.
_SIGN = re.compile(r"[=:]")
_JOINED = [w.encode() for w in NAME_WEIGHTS if NAME_WEIGHTS[w] >= JOINED_LEAST]
_LOWER = bytes(range(256)).lower()
_NO_PART = bytes(c for c in range(256) if not bytes([c]).isalnum())
_BARE = re.compile(r"[^\s\"'`,;{}()\[\]<>]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed patterns' spans: start, end, kind; each kind leftmost and without overlaps."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    flat = "".join(parts)
    score = sum(NAME_WEIGHTS.get(p, 0.0) for p in parts)
    if not score:
        score = max((w for k, w in NAME_WEIGHTS.items() if w >= JOINED_LEAST and flat.endswith(k)), default=0.0)
    return score - sum(NAME_RELIEF.get(p, 0.0) for p in parts[-1:]) if score else 0.0


def may_name(text: str) -> bool:
    """Whether a name in the text can score: a word of NAME_WEIGHTS, or the parts of one with anything between them."""
    lower = text.lower()
    if any(w in lower for w in NAME_WEIGHTS):
        return True
    flat = text.encode("ascii", "ignore").translate(_LOWER, _NO_PART)
    return any(w in flat for w in _JOINED)


def value_score(value: str) -> float:
    """How random a literal looks: bits per character, kinds of characters, length."""
    if len(value) < LITERAL_LEAST or value.lower() in PLACEHOLDERS or len(set(value)) < 4 or any(c.isspace() for c in value):
        return -math.inf
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value) + any(not c.isalnum() for c in value)
    return 0.4 * max(0.0, bits - 2.0) + 0.5 * (kinds - 1) + (0.5 if n >= 16 else 0.0)


def _lex(text: str) -> Iterator[tuple[str, str, int, int]]:
    at, n = 0, len(text)
    while at < n:
        m = _LEX.match(text, at)
        if m is None:
            yield "other", text[at], at, at + 1
            at += 1
            continue
        kind = m.lastgroup
        at = m.end()
        if kind == "string":
            yield kind, m[0][1:-1], m.start() + 1, m.end() - 1
        elif kind not in ("gap", "comment"):
            yield kind, m[0], m.start(), m.end()


def pairs(text: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Name and literals (value, start, end) of each assignment in the lines given, constants propagated."""
    known: dict[str, list[tuple[str, int, int]]] = {}
    out: list[tuple[str, list[tuple[str, int, int]]]] = []
    tokens = [*_lex(text), ("end", "\n", len(text), len(text))]
    k = 0
    while k < len(tokens) - 1:
        kind, name, *_ = tokens[k]
        if kind not in ("name", "string") or tokens[k + 1][0] != "op" or tokens[k + 1][1] not in ("=", ":", ":=", "=>"):
            k += 1
            continue
        j = k + 2
        got: list[tuple[str, int, int]] = []
        while j < len(tokens):  # operands with + between them
            t = tokens[j]
            if t[0] == "string":
                got.append((t[1], t[2], t[3]))
            elif t[0] == "name" and (t[1] in known or t[1].split(".")[-1] in known):
                got += known.get(t[1]) or known[t[1].split(".")[-1]]
            elif t[0] in ("name", "value") and not got:
                m = _BARE.match(text, t[2])
                if m:
                    got.append((m[0], m.start(), m.end()))
                    while j + 1 < len(tokens) and tokens[j + 1][2] < m.end():
                        j += 1
                break
            else:
                break
            j += 1
            if j >= len(tokens) or tokens[j][:2] != ("op", "+"):
                break
            j += 1
        if got:
            short = name.split(".")[-1]
            known[name] = known[short] = got
            out.append((name, got))
        k = max(j if got else k + 1, k + 1)
    return out


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of literals that the lexer's pairs give away, each once."""
    if not _SIGN.search(text):
        return []
    lines, at = [], 0
    for line in text.split("\n"):
        if _SIGN.search(line):
            lines.append((at, line))
        at += len(line) + 1
    joined, starts, total = "\n".join(x for _, x in lines), [], 0
    if not may_name(joined):
        return []
    for begin, line in lines:
        starts.append((total, begin - total))
        total += len(line) + 1
    best: dict[tuple[int, int], float] = {}
    for name, got in pairs(joined):
        score = name_score(name)
        if score <= 0:
            continue
        whole = value_score("".join(value for value, *_ in got))
        for value, a, b in got:
            if a < b and (own := score + max(whole, value_score(value))) >= THRESHOLD:
                best[a, b] = max(best.get((a, b), 0.0), own)
    out, k = [], 0
    for a, b in sorted(best):
        while k + 1 < len(starts) and starts[k + 1][0] <= a:
            k += 1
        out.append((a + starts[k][1], b + starts[k][1], "literal"))
    return out


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: the lexer's are added unless a base span covers them."""
    base = base_spans(text)
    added = [s for s in literal_spans(text) if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        if b <= at:
            continue
        if kind == "assign":  # the name stays
            a = ASSIGN.match(text, a).start(1)
        out += [text[at : max(a, at)], mark] if a >= at else []
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scanned(mark: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = []
            for text in block.column(1).to_pylist():
                base, spans = all_spans(text)
                kinds = Counter(k for *_, k in base)
                rows.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans), *([_redacted(text, spans, mark) if spans else text] if mark is not None else [])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            values = zip(*rows, strict=True)
            columns = [block.column(0).combine_chunks(), *(pa.array(v, t) for v, t in zip(values, kinds, strict=False))]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"]
            yield pa.record_batch(columns, names[: len(columns)])

    return run


def scan_secrets(docs: DataFrame, *, mark: str | None = None) -> DataFrame:
    """A row for each row of (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end in code points, end exclusive. With mark, a column `redacted` has
    the text with every secret replaced by it. Null text is empty; null and repeated doc_id pass
    through; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * (mark is not None)
    return texts.mapInArrow(_scanned(mark), schema)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with the secrets of `text` replaced; n_chars follows, other columns stay."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [all_spans(t)[1] if t else [] for t in texts]
            new = [_redacted(t, s, mark) if s else t for t, s in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = batch.column(k).to_pylist()
                columns[k] = pa.array([len(t) if s else n for t, s, n in zip(new, found, old, strict=True)], batch.schema.field(k).type)
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return scan_secrets(documents(spark, sf_dir))
