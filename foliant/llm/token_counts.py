"""Token counts of whole texts."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import kernels

#: Distinct parts of texts whose tokens a worker remembers; a full memory starts anew.
REMEMBERED = 1_000_000


class Vocabulary:
    """Encodes parts of texts, each distinct part once, and remembers the ids.

    Parts go to the library together, joined by a special token; parts that
    hold the beginning of a special string go alone.
    """

    def __init__(self, path: str, ids: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        special = [t for t in rules["added_tokens"] if t["special"] and t["content"].startswith("<|")]
        self.mark, self.mark_id = (special[-1]["content"], special[-1]["id"]) if special else (None, None)
        self.splits = bool(special) and len(special) == len(rules["added_tokens"]) and _joins_nothing(rules)
        self.ids = ids
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.lengths = np.zeros(0, np.int64)
        self.places = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        alone = [i for i, t in enumerate(texts) if "<" in t]
        for i, ids in zip(alone, self.whole([texts[i] for i in alone])):
            out[i] = np.array(ids, self.pool.dtype)
        rest = [i for i, t in enumerate(texts) if "<" not in t]
        for k in range(0, len(rest), 2000):
            some = rest[k : k + 2000]
            ids = np.array(self.whole([self.mark.join(texts[i] for i in some)])[0], self.pool.dtype)
            cuts = np.flatnonzero(ids == self.mark_id)
            lo = np.concatenate([[0], cuts + 1])
            hi = np.append(cuts, len(ids))
            for i, a, b in zip(some, lo.tolist(), hi.tolist()):
                out[i] = ids[a:b]
        return out

    def look_up(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens, place in the pool) of each part."""
        keys, first, back = np.unique(kernels.hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            if len(self.keys) > REMEMBERED:
                self.forget()
                known[:] = False
            new = np.flatnonzero(~known)
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            ids = self.encode([buf[a:b].tobytes().decode("utf-8", "replace") for a, b in spans])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            places = len(self.pool) + np.cumsum(lengths) - lengths
            if self.ids:
                self.pool = np.concatenate([self.pool, *ids])
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.lengths = np.concatenate([self.lengths, lengths])[order]
            self.places = np.concatenate([self.places, places])[order]
            at = np.searchsorted(self.keys, keys)
        return self.lengths[at][back], self.places[at][back]


def _joins_nothing(rules: dict) -> bool:
    """Whether texts can be cut at kernels.safe_cuts: byte-level runs, or runs with white space dropped."""
    before = rules.get("pre_tokenizer") or {}
    if before.get("type") == "ByteLevel":
        return rules.get("normalizer") is None and before.get("use_regex") is True and before.get("add_prefix_space") is False
    steps = before.get("pretokenizers", [])
    return bool(steps) and steps[0].get("type") == "Split" and "\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in steps[0].get("pattern", {}).get("Regex", "") and steps[0].get("behavior") == "Removed"


_loaded: dict[tuple[str, bool], Vocabulary] = {}


def vocabulary(path: str, ids: bool = False) -> Vocabulary:
    """The worker's own vocabulary of a file, loaded once."""
    if (path, ids) not in _loaded:
        _loaded[path, ids] = Vocabulary(path, ids)
    return _loaded[path, ids]


def _lengths(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            buf, offsets = kernels.buffers(batch.column(1))
            tokens = np.zeros(batch.num_rows, np.int64)
            if vocab.splits:
                for starts, ends, text in kernels.parts(buf, offsets):
                    n, _ = vocab.look_up(buf, starts, ends)
                    low = text[0]
                    sums = np.bincount(text - low, n)
                    tokens[low : low + len(sums)] += sums.astype(np.int64)
            else:
                for i in np.flatnonzero(np.diff(offsets)):
                    tokens[i] = len(vocab.whole([buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")])[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return count


def token_counts(df: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row, by a tokenizers file at the path ``tokenizer``.

    Only lengths leave the workers. Blocks of about 2 MB are cut at safe places
    however the texts lie, and each distinct part is encoded once, in batches.
    A null or empty text has 0 bytes and 0 tokens. A null id stays null;
    repeated rows are counted each by itself; other columns aren't read. An
    empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.mapInArrow(_lengths(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
