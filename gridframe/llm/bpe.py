"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts, for every byte string, exactly one token sequence: the one that applying
the merges in order gives (Berglund, Martens and van der Merwe, 2024). It starts with one state and an arc per byte. The
gadget of the merge (u, v) -> w copies the state that u leads to without its v-arc, sends all u-arcs to the copy, and adds a w-arc
wherever a u-arc was, into the state that v led to. As all arcs of one label lead to one state, a state is a label with the list of arcs
cut from it, and copies share what they have in common: the gadgets compile to tables of births, halves and cuts, in which an
arc is tested by walking down two tokens. Which tokens end at a byte comes from a second table, the transitions of the trie of
all labels with failure links. Words are run through both tables together, one byte of every word at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import pieces, send

#: How the byte-level pre-tokenizer splits text. A fixed value of the public format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Bytes of text that a task works on at a time.
SLICE = 3 << 20
#: Words of one half of a task's memory, about.
MEMORY = 120_000
#: Bytes of words that are run together, and of words that are run alone.
CELLS, LONG = 1 << 20, 2000
#: A rank beyond all merges.
NEVER = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by the format's rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Lookup:
    """Numbers for keys, both in arrays; -1 for a key that is not there."""

    def __init__(self, found: dict[int, int]):
        self.keys = np.array(sorted(found), np.int64)
        self.values = np.array([found[k] for k in sorted(found)], np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)


class Automaton:
    """Compiled merges. Built once on the driver and sent to the tasks; its size is that of the vocabulary."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_letters()
        self.special = dict(special)
        self.label = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items() if token not in special}
        self.label |= {i: token.encode() for token, i in special.items()}
        number = {self.label[i]: i for token, i in vocabulary.items() if token not in special}
        if len({b for b in number if len(b) == 1}) != 256:
            raise ValueError("the vocabulary lacks single bytes")
        size = max(self.label) + 1
        #: The rank at which a token appears, -1 for a byte, and the halves of which it is made.
        self.born = np.full(size, NEVER, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.born[[i for b, i in number.items() if len(b) == 1]] = -1
        self.cuts: dict[int, int] = {}
        for rank, (left, right) in enumerate(merges):
            self.gadget(rank, vocabulary[left], vocabulary[right], vocabulary[left + right])
        self.cut = Lookup(self.cuts)
        del self.cuts
        self._trie([(b, i) for b, i in number.items() if self.born[i] < NEVER], size)

    @classmethod
    def read(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, special = file["model"], {}
        for token in file.get("added_tokens", []):
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"added token with options: {token['content']}")
            special[token["content"]] = token["id"]
        kind = file.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or file.get("normalizer") or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError("only byte-level BPE without normalizer and prefix space is read")
        return cls(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], special)

    def gadget(self, rank: int, u: int, v: int, w: int) -> None:
        """One merge: the state behind u loses its v-arc at this rank, and w-arcs appear beside u-arcs."""
        if self.born[w] < NEVER or self.born[u] == NEVER or self.born[v] == NEVER:
            raise ValueError(f"merge {rank} makes a token twice or uses one that is not there yet")
        self.cuts[u << 32 | v] = rank
        self.left[w], self.right[w], self.born[w] = u, v, rank

    def _trie(self, labels: list[tuple[bytes, int]], size: int) -> None:
        """Transitions of the trie of all labels. For each node: where to go on when there is none, and the longest token that ends
        there; for each token the next shorter one that ends with it (-1 for none)."""
        step: dict[int, int] = {}
        token = [-1]
        for label, i in labels:
            node = 0
            for byte in label:
                node = step.setdefault(node << 8 | byte, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        fail, longest, shorter = [0] * len(token), list(token), [-1] * size
        level = [0]
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in step.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        while level:
            following = []
            for up in level:
                for byte, node in below.get(up, ()):
                    back = fail[up]
                    if up:
                        while back and back << 8 | byte not in step:
                            back = fail[back]
                        back = step.get(back << 8 | byte, 0)
                    fail[node] = back
                    if token[node] >= 0:
                        shorter[token[node]] = longest[back]
                    else:
                        longest[node] = longest[back]
                    following.append(node)
            level = following
        self.step = Lookup(step)
        self.fail, self.longest, self.shorter = (np.array(x, np.int32) for x in (fail, longest, shorter))
        self.size = np.zeros(size, np.int32)
        for label, i in labels:
            self.size[i] = len(label)

    def has_arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the state behind each token has an arc for another.

        The state inherits its cuts from the right halves of its label, each up to the rank at which the label grew. The arc
        grew out of the arcs of the other token's left halves, each of which must have been there at that rank. Of two
        tokens, the one born later is split first, so only halves that were there at the same time meet.
        """
        arc = np.ones(len(state), bool)
        row, x, y = np.arange(len(state)), state.astype(np.int64), token.astype(np.int64)
        until, upto = np.full(len(row), NEVER), np.full(len(row), NEVER)
        while len(row):
            rank = self.cut(x << 32 | y)
            cut = (rank >= 0) & (rank < until) & (rank <= upto)
            arc[row[cut]] = False
            born_x, born_y = self.born[x], self.born[y]
            on = ~cut & ((born_x >= 0) | (born_y >= 0))
            row, x, y, until, upto, born_x, born_y = (a[on] for a in (row, x, y, until, upto, born_x, born_y))
            split = born_x >= born_y
            until, upto = np.where(split, born_x, until), np.where(split, upto, born_y)
            x, y = np.where(split, self.right[x], x), np.where(split, y, self.left[y])
        return arc

    def run(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The one accepted token sequence of each word: for each prefix, the last arc of its only path."""
        out: list[tuple[int, ...]] = [()] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order and len(words[order[-1]]) > LONG:
            i = order.pop()
            out[i] = self._long(words[i])
        at = 0
        while at < len(order):  # words of like lengths, in blocks of bounded size
            most = max(1, len(words[order[at]]))
            stop = at
            while stop < len(order) and len(words[order[stop]]) <= 2 * most and (stop - at) * len(words[order[stop]]) < CELLS:
                stop += 1
            some = order[at : max(stop, at + 1)]
            for i, ids in zip(some, self._block([words[i] for i in some]), strict=True):
                out[i] = ids
            at += len(some)
        return out

    def _block(self, words: list[bytes]) -> list[tuple[int, ...]]:
        n = np.array([len(w) for w in words])
        longest = int(n.max(initial=0))
        flat = np.frombuffer(b"".join(words), np.uint8)
        text = np.zeros((len(words), longest), np.uint8)
        text[np.arange(longest) < n[:, None]] = flat
        last = np.full((len(words), longest + 1), -1, np.int32)
        node = np.zeros(len(words), np.int64)
        for end in range(1, longest + 1):
            live = np.flatnonzero(n >= end)
            byte = text[live, end - 1].astype(np.int64)
            here = node[live]
            to = self.step(here << 8 | byte)
            lost = np.flatnonzero((to < 0) & (here > 0))
            while len(lost):
                here[lost] = self.fail[here[lost]]
                to[lost] = self.step(here[lost] << 8 | byte[lost])
                lost = lost[(to[lost] < 0) & (here[lost] > 0)]
            node[live] = np.maximum(to, 0)
            token = self.longest[node[live]]
            while len(live):
                start = end - self.size[token]
                ok = start == 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self.has_arc(last[live[inner], start[inner]], token[inner])
                last[live[ok], end] = token[ok]
                live, token = live[~ok], self.shorter[token[~ok]]
        ids = np.zeros((len(words), longest), np.int32)
        used, end, live = np.zeros(len(words), np.int64), n.copy(), np.flatnonzero(n)
        while len(live):
            token = last[live, end[live]]
            used[live] += 1
            ids[live, longest - used[live]] = token
            end[live] -= self.size[token]
            live = live[end[live] > 0]
        return [tuple(row[longest - k :]) for row, k in zip(ids.tolist(), used.tolist(), strict=True)]


    def _long(self, word: bytes) -> tuple[int, ...]:
        """The same for one very long word, byte by byte, with its arcs remembered."""
        step = dict(zip(self.step.keys.tolist(), self.step.values.tolist(), strict=True))
        fail, longest, shorter, size = (x.tolist() for x in (self.fail, self.longest, self.shorter, self.size))
        last, arcs, node = [-1] * (len(word) + 1), {}, 0
        for end, byte in enumerate(word, 1):
            while node and node << 8 | byte not in step:
                node = fail[node]
            node = step.get(node << 8 | byte, 0)
            token = longest[node]
            while end > size[token]:
                pair = last[end - size[token]] << 32 | token
                ok = arcs.get(pair)
                if ok is None:
                    ok = arcs[pair] = bool(self.has_arc(np.array([pair >> 32]), np.array([token]))[0])
                if ok:
                    break
                token = shorter[token]
            last[end] = token
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        return tuple(out[::-1])


class Coder:
    """Encodes and decodes within a task; remembers words in two halves, of which the older one is forgotten when the newer one is full."""

    def __init__(self, automaton: Automaton):
        import regex

        self.automaton = automaton
        self.split = regex.compile(SPLIT).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        names = sorted(automaton.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.label = automaton.label

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. The words that are new in these texts are run together."""
        parts: list[list[str]] = []
        special, known, older = self.automaton.special, self.words, self.older
        for text in texts:
            if self.marks is None or not any(name in text for name in special):
                parts.append(self.split(text))
            else:
                parts.append([w for part in self.marks.split(text) for w in ([part] if part in special else self.split(part))])
        seen = {w for words in parts for w in words}
        new = []
        for w in seen:
            if w not in known:
                ids = older.get(w)
                if ids is None:
                    new.append(w)
                else:
                    known[w] = ids
        known.update(zip(new, self.automaton.run([w.encode() for w in new]), strict=True))
        for name in seen & special.keys():
            known[name] = (special[name],)
        out = [list(chain.from_iterable(map(known.__getitem__, words))) for words in parts]
        if len(known) > MEMORY:
            self.words, self.older = {}, known
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after the other, read as UTF-8. Bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


def encode_decode(documents: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """The given columns with ``ids`` (array of int), ``n_tokens`` (long) and ``decoded`` (string) behind them.

    ``tokenizer`` is the path, on the driver, of a byte-level tokenizer file. Each row is coded by itself, so there is no shuffle, and
    ties, repeated rows and ids play no part. A null text counts as empty: no ids, empty ``decoded``. Columns of the input
    that have one of the three names are replaced. An empty table gives an empty one.
    """
    sent = send(documents, Automaton.read(tokenizer))
    kept = [c for c in documents.columns if c not in ("ids", "n_tokens", "decoded")]
    out = documents.select(*kept)
    at = kept.index(text)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(sent())
        for batch in pieces(batches, at, SLICE):
            coded = coder.encode_all([t or "" for t in batch.column(at).to_pylist()])
            offsets = pa.array([0, *_sums(map(len, coded))], pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(list(chain.from_iterable(coded)), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, ids, pa.array(map(len, coded), pa.int64()), pa.array(map(coder.decode, coded), pa.string())], [*kept, "ids", "n_tokens", "decoded"]
            )

    return out.mapInArrow(code, f"{types}, ids array<int>, n_tokens long, decoded string")


def _sums(numbers) -> Iterator[int]:
    total = 0
    for n in numbers:
        total += n
        yield total


def digests(coded: DataFrame) -> DataFrame:
    """SHA-256 of the decimal ids joined by commas, and of the decoded text."""
    ids = F.sha2(F.array_join("ids", ","), 256)
    return coded.withColumns({"ids_sha256": ids, "decoded_sha256": F.sha2("decoded", 256)})
