"""BPE encoding and decoding by prefix-sharing trie traversal (operator 5).

Distinct words go into a trie. A depth-first walk gives every node the last
token of its prefix's encoding: the one vocabulary entry that ends there and may
follow the state at its own start. A prefix that many words share is worked out
once; a word's ids are read back along the states. A pair of tokens may stand
together if no merge across their border comes before the merges that made them.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .byte_bpe import byte_names
from .words import row_chunks

#: Words and pairs kept per Python worker; the memo starts afresh beyond.
MOST_WORDS, MOST_PAIRS = 500_000, 400_000
#: Bytes of text whose distinct words share one trie.
TRIE_BYTES = 4 << 20
#: As in byte_bpe: beyond these code points the tokenizers library splits the text.
_UNUSUAL = re.compile("[^\0-ԯ -⁯]")


class TrieBpe:
    """A BPE file of the tokenizers library whose words are pre-split; byte-level symbols, optional end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token")) or spec.get("decoder"):
            raise ValueError(f"{path}: not a plain word-level BPE file without decoder")
        self.tokenizer = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {v: k for k, v in self.vocab.items()} | {v: k for k, v in self.added.items()}
        steps = [s["pretokenizers"] if s["type"] == "Sequence" else [s] for s in [spec["pre_tokenizer"]]][0]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), regex.V1)
        self.bytes = {b: c for c, b in byte_names().items()}
        self.back = {ord(c): b for c, b in byte_names().items()}
        self.longest = max(len(k) for k in self.vocab)
        self.sizes: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})  # by last two symbols: sizes of the entries that end so, longest first
        for k in self.vocab:
            ended = bool(self.suffix) and k.endswith(self.suffix)
            k = k[: -len(self.suffix)] if ended else k
            self.sizes[ended].setdefault(k[-2:], []).append(len(k))
        for table in self.sizes:
            for k, v in table.items():
                table[k] = sorted({*v}, reverse=True)
        self.merge_rank: dict[int, int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # id -> rank and halves of the first merge that makes it
        for rank, m in enumerate(model["merges"]):
            a, b = (self.vocab[x] for x in (m.split(" ") if isinstance(m, str) else m))
            self.merge_rank.setdefault(a << 32 | b, rank)
            self.made.setdefault(self.vocab[self.names[a] + self.names[b]], (rank, a, b))
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.word_memo: dict[str, tuple[int, str, str]] = {}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _apart(self, a: int, b: int, limit: float) -> bool:
        """No merge joins the border of a and b before `limit`, nor earlier while they were being made."""
        while True:
            if (rank := self.merge_rank.get(a << 32 | b)) is not None and rank < limit:
                return False
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a is None and made_b is None:
                return True
            # The half made later is taken apart; equal merges go from left to right.
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                limit, a = made_a[0], made_a[2]
            else:
                limit, b = made_b[0] + 1, made_b[1]

    def _may_follow(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b, float("inf"))
        return known

    def _stands_alone(self, t: int) -> bool:
        """Encoding the token's own characters gives the token: its halves stand alone, and nothing joins them before their own merge."""
        if (known := self.alone.get(t)) is None:
            if (made := self.made.get(t)) is None:
                known = True
            else:
                rank, a, b = made
                known = self._stands_alone(a) and self._stands_alone(b) and self._apart_until(a, b, rank)
            self.alone[t] = known
        return known

    def _apart_until(self, a: int, b: int, rank: int) -> bool:
        made_a, made_b = self.made.get(a), self.made.get(b)
        if made_a is None and made_b is None:
            return True
        if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
            return self._apart(made_a[2], b, made_a[0])
        return self._apart(a, made_b[1], made_b[0] + 1)

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Token ids of each distinct word (byte-level symbols, not empty)."""
        root: dict = {}
        for w in set(words):
            node = root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        out: dict[str, list[int]] = {}
        path: list[str] = []
        state: list[tuple[int, int]] = [(-1, 0)]  # by depth: last token and its length
        todo = [(1, c, node) for c, node in root.items()]
        while todo:
            depth, c, node = todo.pop()
            del path[depth - 1 :], state[depth:]
            path.append(c)
            text = "".join(path[-self.longest :])
            ends = "" in node
            if len(node) > ends or not self.suffix:
                state.append(self._last(text, depth, state, ""))
            if ends:
                token, size = self._last(text, depth, state, self.suffix) if self.suffix else state[depth]
                ids, at = [token], depth - size
                while at:
                    token, size = state[at]
                    ids.append(token)
                    at -= size
                out[node[""]] = ids[::-1]
            todo += [(depth + 1, k, v) for k, v in node.items() if k]
        return out

    def _last(self, text: str, depth: int, state: list[tuple[int, int]], suffix: str) -> tuple[int, int]:
        get, table = self.vocab.get, self.sizes[bool(suffix)]
        for size in (*table.get(text[-2:], ()), 1):
            if size > depth:
                continue
            t = get(text[-size:] + suffix)
            if t is not None and (self._may_follow(state[depth - size][0], t) if size < depth else self._stands_alone(t)):
                return t, size
        raise ValueError(f"no token ends {text!r}: its symbols are not all in the vocabulary")

    def _symbols(self, word: str) -> str:
        return word.encode("utf-8").decode("latin-1").translate(self.bytes)

    def _shown(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])

    def _words(self, text: str) -> list[str]:
        """The text's pre-split words; `\0` and a special token's string stand for that token."""
        if self.split_added and any(a in text for a in self.added):
            return [w for part in self.split_added.split(text) for w in (["\0" + part] if part in self.added else self._words(part))]
        if _UNUSUAL.search(text):
            norm = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
            return [w.translate(self.back).encode("latin-1").decode() for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(norm)]
        # Lower-casing is by character there, without the final sigma; white space only separates.
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: how many ids, the ids joined by spaces, the decoded text."""
        split = [self._words(t) for t in texts]
        if len(self.word_memo) > MOST_WORDS:
            self.word_memo.clear()
        memo = self.word_memo
        missing = set().union(*split) - memo.keys()
        special = {"\0" + a: i for a, i in self.added.items()}
        symbols = {w: self._symbols(w) for w in missing if w not in special}
        ids = self.encode_words(list(symbols.values()))
        memo.update((w, self._shown(ids[symbols[w]] if w in symbols else [special[w]])) for w in missing)
        out = []
        for words in split:
            found = [memo[w] for w in words]
            out.append((sum([f[0] for f in found]), " ".join([f[1] for f in found]), " ".join([f[2] for f in found])))
        return out


@lru_cache(maxsize=4)
def trie_bpe(path: str) -> TrieBpe:
    return TrieBpe(path)


def encode_texts(docs: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_tokens, ids (array of int) and decoded; with `digests` instead ids_sha256 and decoded_sha256.

    Ids are those of the whole text without added special tokens, decoding
    keeps special ones. A null or empty text has no ids and an empty decoded
    text. doc_id may be null or repeated; other columns are not looked at.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = trie_bpe(tokenizer)
        for batch in batches:
            n, ids, decoded = [], [], []
            texts = [t.as_py() or "" for t in batch.column(1)]
            for a, b in row_chunks(np.cumsum([0, *map(len, texts)]), TRIE_BYTES):
                for many, line, shown in bpe.encode(texts[a:b]):
                    n.append(many)
                    ids.append(hashlib.sha256(line.encode()).hexdigest() if digests else [int(x) for x in line.split()])
                    decoded.append(hashlib.sha256(shown.encode()).hexdigest() if digests else shown)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = ("long", "long", "string", "string") if digests else ("long", "long", "array<int>", "string")
    return docs.select("doc_id", "text").mapInArrow(work, ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True)))
