"""Token counts with a whole-token shortcut.

Offline, once a worker process, the vocabulary is gone through: a vocabulary string counts as *whole* if the tokenizer,
given that string alone, returns exactly one token. A text is cut into pre-tokens by the tokenizer's own pattern; a
pre-token found among the whole strings counts 1 without any merging. Only the other pre-tokens are merged, by the
library, and remembered (a bounded memory: it is emptied when full).

The shortcut is used for texts whose characters every regular-expression library classes alike; other texts
(``UNSURE``) go through the library entirely, so the counts never differ from it. Special strings inside a text are
cut out first, as the library does by default, and count 1 each.

Defined results: null text is the empty text, with 0 bytes and 0 tokens; every row gives one row, repeated rows and null
doc_ids too; a text of any length is counted whole; other columns are left out, so none can clash; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_lists

LIMIT = 1024
#: Controls, superscript digits, newly assigned and rare scripts: characters that libraries may class differently.
UNSURE = re.compile(r"[^\x09-\x0D\x20-\x7E\xA0-\xB1\xB4-\xB8\xBA\xBB\xBF-\u012F\u0131-\u024F\u0391-\u03A1\u03A3-\u03C9\u0410-\u044F\u2010-\u2027\u2030-\u203A\u20AC]")
#: The tokenizer's pattern in the standard library's terms; equal to it on texts without UNSURE characters.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
MEMORY = 400_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes, by their public rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> set[str]:
    """Vocabulary strings that alone encode as one token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    letters = byte_letters()
    texts = []
    for token in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
        try:
            texts.append(bytes(letters[c] for c in token).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            pass
    return {t for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1}


class Costs(dict):
    """Tokens by pre-token. Whole tokens are there from the start; a miss is merged and remembered.

    Two generations bound the memory: when the younger one is full it becomes the elder, whose entries come back on use.
    """

    def __init__(self, whole: set[str], merge, memory: int):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.merge, self.memory, self.elder, self.merged = whole, merge, memory, {}, 0

    def __missing__(self, piece: str) -> int:
        n = self.elder.get(piece)
        if n is None:
            n = self.merge(piece)
            self.merged += 1
        if len(self) >= self.memory + len(self.whole):
            self.elder = dict(self)
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[piece] = n
        return n


class Counter:
    """Counts the tokens of texts for one byte-level tokenizer file."""

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        model, stand_in = self.tokenizer.model, str.maketrans({chr(b): c for c, b in byte_letters().items()})
        self.cost = Costs(whole_tokens(path), lambda piece: len(model.tokenize(piece.encode().decode("latin-1").translate(stand_in))), memory)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if UNSURE.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts, n = [text], 0
        for s in self.specials:
            if s in text:
                parts = [y for x in parts for y in x.split(s)]
                n = len(parts) - 1
        return n + sum(sum(map(self.cost.__getitem__, PIECES.findall(part))) for part in parts)


@functools.cache
def counter(path: str) -> Counter:
    """The counter of a tokenizer file, with its whole strings and what it remembers: once a process."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit. ``path`` must exist on every executor (an installed package's file)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        own = counter(path)

        def fn(ids, texts, sizes):
            return ids, sizes, [own.count(t) for t in texts]

        return fn

    slim = docs.select("doc_id", F.col(f"`{text}`").alias("text"), F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long").alias("n_bytes"))
    return map_lists(slim, make, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
