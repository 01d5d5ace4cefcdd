"""Token counts by a whole-token shortcut over byte-level BPE.

Offline, every vocabulary string is encoded alone; those that come back as
their own single token are proven whole. Texts are cut into pre-tokens by the
tokenizer's own pattern; a pre-token in the proven set counts one, and only
the rest is merged by the tokenizer, each distinct one once per worker and
memory span.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import chunks

# The pre-tokenization pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of distinct merged pre-tokens that a worker remembers before it
#: starts anew; longer ones than ``LONGEST`` are counted each time.
REMEMBERED, LONGEST = 8_000_000, 256


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves; the other bytes, in
    order, for the code points from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def proven_whole(path: str) -> set[str]:
    """Vocabulary strings that, encoded alone, come back as one token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = set(tokenizer.get_added_tokens_decoder())
    byte = _bytes_of_symbols()
    strings, ids = [], []
    for symbols, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if number in special or any(s not in byte for s in symbols):
            continue
        try:
            strings.append(bytes(byte[s] for s in symbols).decode())
        except UnicodeDecodeError:
            continue
        ids.append(number)
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return {s for s, number, e in zip(strings, ids, encoded, strict=True) if e.ids == [number]}


def _supported(path: str) -> list[str]:
    """The special strings; raises if the file isn't plain byte-level BPE."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cut = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"{path} isn't byte-level BPE with the standard pattern")
    added = spec["added_tokens"] or []
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
        raise ValueError(f"{path} has added tokens that depend on their surroundings")
    return sorted((a["content"] for a in added), key=len, reverse=True)


class Counter:
    """Counts a text's tokens as the tokenizer does by default."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        special = _supported(path)
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("|".join(map(regex.escape, special))).split if special else None
        self.tokenizer = Tokenizer.from_file(path)
        self.whole = dict.fromkeys(proven_whole(path), 1)
        self.known, self.held = dict(self.whole), 0

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        found, extra = [], []
        for text in texts:
            parts = self.split(text) if self.split else [text]
            found.append([self.find(p) for p in parts])
            extra.append(len(parts) - 1)
        new = {x for parts in found for p in parts for x in p if x not in self.known}
        if self.held + sum(map(len, new)) > REMEMBERED:
            self.known, self.held = dict(self.whole), 0
            new = {x for parts in found for p in parts for x in p if x not in self.known}
        passing = []
        for x, n in self._merged(list(new)):
            self.known[x] = n
            self.held += len(x)
            if len(x) > LONGEST:
                passing.append(x)
        get = self.known.__getitem__
        counted = [more + sum(sum(map(get, p)) for p in parts) for parts, more in zip(found, extra, strict=True)]
        for x in passing:
            del self.known[x]
            self.held -= len(x)
        return counted

    def _merged(self, strings: list[str]) -> Iterator[tuple[str, int]]:
        for at in range(0, len(strings), 4096):
            some = strings[at : at + 4096]
            yield from zip(some, map(len, self.tokenizer.encode_batch(some, add_special_tokens=False)), strict=True)


_counters: dict[str, Counter] = {}


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = counter.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Tokens of every whole text, as the tokenizer at ``path`` gives them.

    ``docs`` needs ``doc_id`` and ``text`` (null: empty, 0 tokens); other
    columns are ignored. ``path`` must exist on every executor. No begin or
    end tokens, truncation or padding; a special string inside a text is one
    token, the tokenizer's default. Returns one row per row: ``doc_id``,
    ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > limit), repeated
    rows too; an empty table gives none.
    """
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return texts.mapInArrow(_count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
