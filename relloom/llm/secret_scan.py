"""Secret scans: fixed patterns, and a lexer of assignments with constant propagation.

The lexer (``assignments.py``) reads source and configuration syntax as names and literals, and finds for each
name used as a value the literal it stands for. A literal is scored by all names it reaches, its own and those
it is passed on to: sensitive parts of the name, the spread of its characters, and signs of a placeholder. The
key or section around it counts ``NESTED`` less. Literals that reach ``THRESHOLD`` give spans of kind ``literal``.

Kinds: ``assign``, ``access`` and ``hex`` (fixed patterns, see ``PATTERNS``), then ``literal``.
Spans are code points, ends exclusive. Null and empty texts have no spans. Rows with the same id are
judged each on its own; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relloom.llm import assignments

KINDS = ("assign", "access", "hex", "literal")
# The patterns of the base kinds and the least length of each.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts of a target name and what each adds to a literal's score.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 1.0,
    "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "bearer": 0.9, "signingkey": 1.0, "encryptionkey": 1.0, "key": 0.4, "salt": 0.5,
}
PLACEHOLDER = re.compile(
    r"example|changeme|placeholder|dummy|your[_-]|xxxx|\*\*\*|<[^>]*>|\$\{|\{\{|^(?:none|null|true|false|test|todo)$",
    re.IGNORECASE,
)
THRESHOLD = 1.0
LITERAL_LEAST = 6
#: What the name of a key or section around a literal counts less than a name of its own.
NESTED = 0.2


def entropy(literal: str) -> float:
    """Bits per character."""
    n = len(literal)
    return -sum(c / n * math.log2(c / n) for c in Counter(literal).values()) if n else 0.0


def name_score(name: str) -> float:
    """How sensitive a target name is: its parts, alone and two in a row joined."""
    parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())
    joined = [*parts, *(a + b for a, b in zip(parts, parts[1:]))]
    return max((SENSITIVE.get(p, 0.0) for p in joined), default=0.0)


def literal_score(names: list[str], literal: str) -> float:
    """Score of a literal by the most sensitive name it reaches, its spread and its looks."""
    if len(literal) < LITERAL_LEAST or PLACEHOLDER.search(literal):
        return 0.0
    score = max(map(name_score, names), default=0.0)
    kinds = sum(any(f(c) for c in literal) for f in (str.isdigit, str.isupper, str.islower))
    spread = entropy(literal)
    return score + (0.4 if spread >= 3.5 and kinds >= 2 else 0.1 if kinds >= 2 and spread >= 2.5 else -0.3)


def literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, target name, score) of the literals that reach the threshold."""
    found = assignments.pairs(text, name_score)
    to = assignments.definitions(found)
    reached: list[dict[str, bool]] = [dict.fromkeys(p.names, True) for p in found]
    for pair, k in zip(found, to, strict=True):
        if k is not None:
            reached[k].update(dict.fromkeys(pair.names, True))
    out = {}
    for pair, k, names in zip(found, to, reached, strict=True):
        # A bare word is a literal only if it holds more than a plain word or name does.
        bare = pair.refers
        if k is not None or bare and not (re.search(r"[0-9]", bare) and re.search(r"[A-Za-z]", bare)):
            continue
        score, best = literal_score(list(names), pair.literal), max(names, key=name_score)
        if pair.around is not None:
            nested = literal_score([pair.around], pair.literal) - NESTED
            score, best = max((score, best), (nested, pair.around), key=lambda x: x[0])
        if score >= THRESHOLD:
            for a, b in pair.spans:
                if a < b and score > out.get((a, b), ("", 0.0))[1]:
                    out[a, b] = best, score
    return [(a, b, *out[a, b]) for a, b in sorted(out)]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, in order of start, then kind as listed."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return [(a, KINDS[k], b) for a, k, b in out]


def scan(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int, str, float]]]:
    """Base spans, and the lexer's own with their target name and score."""
    if not text:
        return [], []
    base = base_spans(text)
    own = [(a, "literal", b, n, s) for a, b, n, s in literals(text)] if ":" in text or "=" in text or "</" in text else []
    return base, own


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b, *_ in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, targets) for every row.

    ``spans``: all spans as ``kind:start:end``; ``targets``: the lexer's literals with the name each
    reaches and its score.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    target = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, spans, targets = [], [], []
            for value in batch.column(1):
                base, own = scan(value.as_py())
                for k, n in enumerate(counts):
                    n.append(sum(x[1] == KINDS[k] for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted([*base, *(x[:3] for x in own)], key=lambda x: (x[0], KINDS.index(x[1])))))
                targets.append([{"start": a, "end": b, "name": n, "score": s} for a, _, b, n, s in own])
            arrays = [batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string())]
            yield pa.record_batch(
                [*arrays, pa.array(spans, pa.string()), pa.array(targets, target)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "targets"],
            )

    return rows.mapInArrow(
        run,
        f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string,"
        " targets array<struct<start:int,end:int,name:string,score:double>>",
    )


MASK = "[SECRET]"


def masked(text: str) -> str:
    """The text with every span, overlapping ones merged, replaced by MASK."""
    base, own = scan(text)
    out, done = [], 0
    start = end = -1
    for a, b in [*sorted((x[0], x[2]) for x in [*base, *own]), (len(text) + 1, len(text) + 1)]:
        if a < end:
            end = max(end, b)
            continue
        if start >= 0:
            out += [text[done:start], MASK]
            done = end
        start, end = a, b
    return "".join([*out, text[done:]])


def without_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all found spans masked in the text; rows, columns and their order stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            columns = list(batch.columns)
            texts = [masked(t) if t else t for t in columns[k].to_pylist()]
            columns[k] = pa.array(texts, batch.schema.field(k).type)
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
