"""Secrets in texts: certain patterns, and weak parts that count only beside their counterparts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import kernels
from foliant.llm.scratch import Scratch

#: Parts are complementary when they start at most this many code points apart.
SCOPE = 400
#: In the order in which equal starts are listed. The first three are certain, the others weak.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
#: What a kind gives: who, the secret itself, or where.
ROLES = {"assign": "secret", "hex": "secret", "key": "secret", "access": "who", "id": "who", "endpoint": "where"}
#: What must lie in a weak part's scope for it to be reported.
COMPLEMENTS = {"id": ("secret",), "key": ("who", "where"), "endpoint": ("secret",)}
PATTERNS = {
    "assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "id": re.compile(r"\b(?:user(?:name|_?id)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}", re.ASCII | re.IGNORECASE),
    "key": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/_=-])"),
    "endpoint": re.compile(r"https?://[^\s\"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])", re.ASCII),
}
_WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey", b"akia", b"http", b"user", b"login", b"account", b"client")
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_KEY = np.zeros(256, bool)
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NO_SPANS = hashlib.sha256(b"").hexdigest()


def _long_runs(which: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of this many bytes or more start and end."""
    edges = np.flatnonzero(np.diff(which.view(np.int8), prepend=0, append=0))
    long = edges[1::2] - edges[0::2] >= least
    return edges[0::2][long], edges[1::2][long]


def suspects(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of the texts in which a pattern can match at all; a hit over text borders only adds some."""
    hits = [_long_runs(_HEX[buf], 24), _long_runs(_KEY[buf], 32)]
    if len(buf) > 2:
        dots = np.flatnonzero((buf[1:-1] == 46) & _DIGIT[buf[:-2]] & _DIGIT[buf[2:]])
        hits.append((dots, dots + 3))
    low = buf.tobytes().lower()
    for word in _WORDS:
        at, found = low.find(word), []
        while at >= 0:
            found.append(at)
            at = low.find(word, at + 1)
        hits.append((np.array(found, np.int64), np.array(found, np.int64) + len(word)))
    # Every text from the one in which a hit starts to the one in which it ends.
    first = np.searchsorted(offsets, np.concatenate([s for s, _ in hits]), "right") - 1
    last = np.searchsorted(offsets, np.concatenate([e for _, e in hits]) - 1, "right") - 1
    n = len(offsets)
    return np.flatnonzero(np.cumsum(np.bincount(first, minlength=n) - np.bincount(last + 1, minlength=n)) > 0)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base spans, and of weak ones that touch none of them."""
    spans = []
    for kind in KINDS[:3]:
        for m in PATTERNS[kind].finditer(text):
            size = len(m[2]) if kind == "assign" else m.end() - m.start()
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                spans.append((kind, m.start(), m.end()))
    taken = sorted((s, e) for _, s, e in spans)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else []
    for kind in KINDS[3:]:
        for m in PATTERNS[kind].finditer(text):
            before = int(np.searchsorted(starts, m.end()))  # base spans that start before this one ends
            if not before or reach[before - 1] <= m.start():
                spans.append((kind, m.start(), m.end()))
    return spans


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        buf, offsets = kernels.buffers(batch.column(1))
        found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + 4 * kernels.BLOCK, "right")) - 1)
            own = offsets[first : last + 1] - offsets[first]
            some = buf[offsets[first] : offsets[last]]
            for i in suspects(some, own).tolist():
                spans = find_spans(some[own[i] : own[i + 1]].tobytes().decode("utf-8", "replace"))
                found[first + i] = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
            first = last
        counts = [[sum(x["kind"] == kind for x in f) for f in found] for kind in KINDS[:3]]
        digests = []
        for f in found:
            base = sorted((x["start"], KINDS.index(x["kind"]), x["end"]) for x in f if x["kind"] in KINDS[:3])
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest() if base else _NO_SPANS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(found, pa.list_(part))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "parts"]
        )


def secret_scan(df: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Workers list the parts of each whole text. Parts that are certain are all
    reported. Weak ones (a user, a key-like string, an endpoint) are reported
    when a complementary part starts within ``scope`` code points: an interval
    join over ranges of that length, in which only so many parts fit, so a
    text with very many parts costs in proportion to them.

    A null or empty text has no spans. Rows are told apart by a row number, so
    null and repeated ids are fine; columns that aren't named aren't read. An
    empty table gives no rows. Equal starts go by the order of KINDS.
    """
    scratch = Scratch(df.sparkSession, "secrets")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, parts array<struct<kind string, start long, end long>>"
    found = scratch.save(rows.mapInArrow(_scan, schema).withColumn("row", F.monotonically_increasing_id()))

    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    parts = found.select("row", F.explode("parts").alias("p")).select("row", "p.*").withColumn("role", role[F.col("kind")])
    parts = parts.withColumn("range", F.expr(f"start div {scope}"))
    weak = parts.where(F.col("kind").isin(*COMPLEMENTS)).withColumn("near", F.explode(F.expr("array(range - 1, range, range + 1)")))
    other = parts.select("row", F.col("range").alias("near"), F.col("start").alias("other_start"), F.col("role").alias("other_role")).distinct()
    fits = F.lit(False)
    for kind, roles in COMPLEMENTS.items():
        fits = fits | ((F.col("kind") == kind) & F.col("other_role").isin(*roles))
    linked = weak.join(other, ["row", "near"]).where(fits & (F.abs(F.col("start") - F.col("other_start")) <= scope))
    linked = linked.select("row", "kind", "start", "end").distinct().groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))

    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    out = found.join(linked, "row", "left").withColumn("linked", F.coalesce("linked", F.expr("filter(parts, p -> false)")))
    every = F.concat(F.filter("parts", lambda p: p["kind"].isin(*KINDS[:3])), F.col("linked"))
    ordered = F.sort_array(F.transform(every, lambda p: F.struct(p["start"].alias("s"), rank[p["kind"]].alias("k"), p["end"].alias("e"), p["kind"].alias("kind"))))
    spans = F.array_join(F.transform(ordered, lambda p: F.concat_ws(":", p["kind"], p["s"], p["e"])), ",")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.size("linked").cast("long").alias("n_linked"))
