"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from a public model file, whose path is a parameter. Its scores are merge ranks, so the log score of a piece is that of a
Zipf law over the ranks. White space is marked by U+2581, the text starts with a mark, and a character that no piece covers falls back
to its UTF-8 bytes. A U+2581 of the text itself goes through its bytes too, so that decoding gives back every text exactly.

No piece holds a mark behind another character, so the best path of a text is the best paths of its marked words. The words of a chunk of
texts that are not remembered go through one Viterbi together, a byte position at a time for all of them; what is remembered ages out
in two generations.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame

from evidentia.llm.common import map_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Added to the least log score for a character that no piece covers.
UNKNOWN = -10.0
#: Words in each of the two generations that a process remembers, and the longest word in bytes that is remembered or coded with others.
MEMORY, REMEMBERED = 1 << 17, 64
#: Words that are coded together.
TOGETHER = 8192
ENCODED = "doc_id long, n_pieces long, n_byte_pieces long, ids array<int>, exact boolean"


class Vocabulary:
    """Pieces with log scores; ``byte_ids[b]`` is the piece of byte b. Only the ordinary pieces match text."""

    def __init__(self, pieces: list[str], scores: list[float], ordinary: list[bool], byte_ids: list[int]):
        self.pieces, self.scores, self.ordinary, self.byte_ids = pieces, scores, ordinary, byte_ids

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Reads a model file; the log score of the piece of rank r is -ln(r + 1) - ln(H), H the sum of 1 / (r + 1)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        ordinary = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        ranks = [min(-model.get_score(i), float(n)) for i in range(n)]
        total = math.log(sum(1 / (r + 1) for r, ok in zip(ranks, ordinary, strict=True) if ok))
        scores = [-math.log(r + 1) - total if ok else 0.0 for r, ok in zip(ranks, ordinary, strict=True)]
        return cls(pieces, scores, ordinary, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


class DoubleArray:
    """A trie over bytes in two arrays: the child of node s by byte c is t = base[s] + c if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for key, value in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = value
        size = len(children) + 1024
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = -2
        first_free, hint, place, queue = 257, 257, {0: 0}, [0]
        for node in queue:
            kids = children[node]
            if not kids:
                continue
            low, others = min(kids), list(kids)
            while self.check[first_free] != -1:
                first_free += 1
            # Dense regions are tried by single children only; a long search moves the start of later ones.
            at = tried = first_free if len(kids) == 1 else max(first_free, hint)
            while True:
                base = at - low
                if base + 256 >= len(self.check):
                    more = len(self.check)
                    self.base += [0] * more
                    self.check += [-1] * more
                    self.value += [-1] * more
                if self.check[at] == -1 and all(self.check[base + c] == -1 for c in others):
                    break
                at += 1
            if at - tried > 64:
                hint = at - 32
            here = place[node]
            self.base[here] = base
            for c, kid in kids.items():
                self.check[base + c] = here
                self.value[base + c] = ends[kid]
                place[kid] = base + c
                queue.append(kid)


class Encoder:
    """Encodes and decodes whole texts."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.vocabulary = v
        self.trie = DoubleArray({p.encode(): i for i, (p, ok) in enumerate(zip(v.pieces, v.ordinary, strict=True)) if ok})
        if any(MARK in p.lstrip(MARK) for p, ok in zip(v.pieces, v.ordinary, strict=True) if ok):
            raise ValueError("a piece holds a mark behind another character")
        self.unknown = min(s for s, ok in zip(v.scores, v.ordinary, strict=True) if ok) + UNKNOWN
        apart = "".join(c for c in "\n\r\t" if not any(c in p for p, ok in zip(v.pieces, v.ordinary, strict=True) if ok))
        self.words = re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+" + (f"|[{apart}]" if apart else ""))
        self.bytes_of = [p.replace(MARK, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.is_byte = np.zeros(len(v.pieces), bool)
        self.is_byte[v.byte_ids] = True
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        self.scores = np.array(v.scores)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def best_path(self, text: bytes) -> list[int]:
        """Viterbi: the pieces of the path with the highest sum of log scores; ties go to the path whose last piece starts first."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.vocabulary.scores
        n = len(text)
        best, start, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == -math.inf:
                continue
            lead = text[i]
            end = i + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            node, single = 0, False
            for j in range(i, n):
                t = base[node] + text[j]
                if check[t] != node:
                    break
                node = t
                if (v := value[t]) >= 0:
                    if j + 1 == end:
                        single = True
                    if (s := here + scores[v]) > best[j + 1]:
                        best[j + 1], start[j + 1], piece[j + 1] = s, i, v
            if not single and here + self.unknown > best[end]:
                best[end], start[end], piece[end] = here + self.unknown, i, -1
        out: list[int] = []
        while n:
            i, v = start[n], piece[n]
            out += [v] if v >= 0 else [self.vocabulary.byte_ids[b] for b in reversed(text[i:n])]
            n = i
        return out[::-1]

    def best_paths(self, words: list[bytes]) -> list[bytes]:
        """``best_path`` of many words, as bytes of 32-bit numbers: the same sums and the same ties, for all words at once."""
        n, length = len(words), np.array([len(w) for w in words])
        width = int(length.max())
        data = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width).T.astype(np.int32)
        best, start, piece = np.full((width + 1, n), -np.inf), np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        best[0] = 0.0
        for i in range(width):
            at = np.flatnonzero((best[i] > -np.inf) & (length > i))
            if not len(at):
                continue
            lead = data[i, at]
            end = i + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(at), bool)
            place, own, node = np.arange(len(at)), at, np.zeros(len(at), np.int32)
            for j in range(i, width):
                t = self.base[node] + data[j, own]
                ok = (self.check[t] == node) & (length[own] > j)
                place, own, node = place[ok], own[ok], t[ok]
                if not len(own):
                    break
                v = self.value[node]
                some = np.flatnonzero(v >= 0)
                single[place[some]] |= end[place[some]] == j + 1
                s = best[i, own[some]] + self.scores[v[some]]
                better = s > best[j + 1, own[some]]
                some, s = some[better], s[better]
                best[j + 1, own[some]], start[j + 1, own[some]], piece[j + 1, own[some]] = s, i, v[some]
            left, end = at[~single], end[~single]
            s = best[i, left] + self.unknown
            better = s > best[end, left]
            left, end = left[better], end[better]
            best[end, left], start[end, left], piece[end, left] = s[better], i, -1
        path, count, covered = np.zeros((n, width), np.int32), np.zeros(n, np.int64), np.ones(n, bool)
        at, where = np.arange(n), length.copy()
        while len(at):
            found = piece[where, at]
            covered[at] &= found >= 0
            count[at] += 1
            path[at, width - count[at]] = found
            where = start[where, at]
            at, where = at[where > 0], where[where > 0]
        flat, ends = path.tobytes(), 4 * width * np.arange(1, n + 1)
        return [flat[e - 4 * c : e] if ok else np.array(self.best_path(w), np.int32).tobytes() for w, c, e, ok in zip(words, count.tolist(), ends.tolist(), covered.tolist(), strict=True)]

    def word(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            raw = word.encode()
            found = np.array(self.best_path(raw), np.int32).tobytes()
            if len(raw) > REMEMBERED:
                return found
        self.memory[word] = found
        return found

    def learn(self, words: set[str]) -> None:
        """Remembers the paths of these words, so far as they are of a length to be remembered."""
        if len(self.memory) >= MEMORY:
            self.memory, self.older = {}, self.memory
        new = sorted([(len(raw), w, raw) for w in words if w not in self.memory and w not in self.older and len(raw := w.encode()) <= REMEMBERED])
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            self.memory.update(zip([w for _, w, _ in some], self.best_paths([raw for _, _, raw in some]), strict=True))

    def split(self, text: str | None) -> list[list[str]]:
        """The marked words of a text, in parts that were apart by a mark of its own."""
        return [self.words.findall(part.replace(" ", MARK)) for part in (" " + text).split(MARK)] if text else []

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The piece numbers of whole texts; none for a null or empty one."""
        split = [self.split(t) for t in texts]
        self.learn({w for parts in split for words in parts for w in words})
        own_mark = np.array([self.vocabulary.byte_ids[b] for b in MARK.encode()], np.int32).tobytes()
        word, memory = self.word, self.memory
        return [np.frombuffer(own_mark.join([b"".join([memory.get(w) or word(w) for w in words]) for words in parts]), np.int32) for parts in split]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        """The text of piece numbers: bytes joined, marks as spaces, the first one dropped."""
        table = self.bytes_of
        return b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")[1:]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary.load(path))
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Piece numbers of every whole text, and whether decoding them gave the text back. A null text counts as empty and encodes to no pieces.

    The model file is read where the task runs, so it must be on every worker. Repeated rows repeat, an empty table gives no rows; other
    columns are not read.
    """

    def make():
        enc = encoder(model)

        def step(rows: dict) -> dict:
            ids = enc.encode_many(rows["text"])
            return {
                "doc_id": rows["doc_id"],
                "n_pieces": list(map(len, ids)),
                "n_byte_pieces": [int(enc.is_byte[x].sum()) for x in ids],
                "ids": ids,
                "exact": [enc.decode(x) == (t or "") for x, t in zip(ids, rows["text"], strict=True)],
            }

        return step

    return map_chunks(docs.select("doc_id", "text"), make, ENCODED)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows with piece numbers ``ids``; null numbers give a null text."""

    def make():
        enc = encoder(model)
        return lambda rows: {"doc_id": rows["doc_id"], "text": [None if x is None else enc.decode(x) for x in rows["ids"]]}

    return map_chunks(encoded.select("doc_id", "ids"), make, "doc_id long, text string")
