"""SentencePiece encoding and decoding by N-best segmentation.

The lattice of a text has an edge for each piece of the model that its characters spell, and an unknown edge for a
character that no piece spells. A forward Viterbi pass gives the best score up to each place; searched backwards
from the end, these scores are exact heuristics, so A* pops complete segmentations in order of their scores.
Scores are the pieces' log probabilities. A unigram model has them; a BPE model has merge ranks instead, of which
Zipf's law makes scores, -log(rank + 2), so that frequent pieces and few pieces win. Its best path need not be the
path of greedy merges.

Scores are rounded to multiples of 2 ** -24, whose sums are exact, so that equal scores are equal in any order.
Segmentations of equal score come in the order of their ids. The forward pass keeps, of equal scores, the prefix of
the least ids, so that the heuristic is exact for this order too: every entry of the agenda stands for one whole
segmentation, its own best, and the agenda never needs more entries than segmentations are wanted.

No piece has a word-begin mark after another character and none has an unknown character, so all segmentations cut
there: the lattice falls into words, whose best segmentations and losses of the second best are kept in a bounded
cache. The N best of a text differ from its best one only at the N - 1 words whose second best costs least (of equal
ones, those that come first in the order of ids), so A* runs there, and their results are put together exactly.

Defined cases: null and empty texts have no pieces and one segmentation of score 0; characters beyond the vocabulary
become byte pieces, or the unknown piece where the model has none; the mark U+2581 in a text decodes to a space;
repeated rows give repeated rows and null ids stay; encoding_report leaves other columns out; encode_texts passes
them through, own ones named like its output as <name>_own.
"""

from __future__ import annotations

import functools
import math
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded, packed, put_aside, unpacked

MARK = "▁"
N_BEST, CACHE_WORDS, UNKNOWN_PENALTY = 3, 400_000, 10.0
#: Letters of the words that are kept in the caches.
SHORT = 64
#: Bytes of texts whose new words are looked up together, and how many new words make that worth while.
CHUNK, TOGETHER = 1 << 20, 64
#: Scores are multiples of 1 / UNIT.
UNIT = 1 << 24
#: Where the model file is, unless the session's setting factloom.sentencepiece.model says otherwise.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Model:
    """Pieces with ids and scores, as read from a model file."""

    pieces: list[str]
    ids: dict[str, int]
    scores: list[float]
    bytes_: dict[int, int]
    unknown: int
    dummy_prefix: bool
    unknown_score: float = 0.0
    begins: dict[str, int] = field(default_factory=dict)
    chars: frozenset = frozenset()
    spelled: list[bytes] = field(default_factory=list)

    @functools.cached_property
    def steps(self) -> Steps:
        return Steps(self)

    @staticmethod
    def parse(raw: bytes) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        kinds = {k: proto.SentencePiece.Type.Value(k) for k in ("NORMAL", "UNKNOWN", "USER_DEFINED", "BYTE", "CONTROL")}
        ranked = proto.trainer_spec.model_type == proto.trainer_spec.ModelType.Value("BPE")
        pieces, scores = [p.piece for p in proto.pieces], [round(UNIT * (-math.log(2 - p.score) if ranked else p.score)) / UNIT for p in proto.pieces]
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in {kinds["NORMAL"], kinds["USER_DEFINED"]}}
        bytes_ = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds["BYTE"]}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece runs over a word's end")
        model = Model(pieces, ids, scores, bytes_, next(i for i, p in enumerate(proto.pieces) if p.type == kinds["UNKNOWN"]), proto.normalizer_spec.add_dummy_prefix)
        model.unknown_score = min(s for s, p in zip(scores, proto.pieces, strict=True) if p.type == kinds["NORMAL"]) - UNKNOWN_PENALTY
        model.begins = {x[:k]: -1 for x in ids for k in range(1, len(x))} | ids  # beginnings of pieces, and pieces
        model.chars = frozenset("".join(ids)) | {MARK}
        back = {i: bytes([b]) for b, i in bytes_.items()}
        model.spelled = [back.get(i, b"" if p.type == kinds["CONTROL"] else (" ⁇ " if p.type == kinds["UNKNOWN"] else p.piece).replace(MARK, " ").encode()) for i, p in enumerate(proto.pieces)]
        return model


def lattice(word: str, model: Model) -> list[list[tuple[int, int, float]]]:
    """For each place, the edges that end there: (start, id, score)."""
    size = len(word)
    ends: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]
    get, scores = model.begins.get, model.scores
    for i in range(size):
        if word[i] not in model.ids:
            ends[i + 1].append((i, model.unknown, model.unknown_score))
        for j in range(i + 1, size + 1):
            k = get(word[i:j])
            if k is None:  # no piece begins so
                break
            if k >= 0:
                ends[j].append((i, k, scores[k]))
    return ends


class Paths:
    """The best prefix of each place as a tree: place 0 is the root, and a place's parent is where its last piece starts."""

    def __init__(self) -> None:
        self.parent, self.piece, self.depth, self.jump = [0], [-1], [0], [0]

    def add(self, parent: int, piece: int) -> None:
        """The next place. Its jump goes up a number of pieces that makes any climb logarithmic."""
        self.parent.append(parent)
        self.piece.append(piece)
        self.depth.append(self.depth[parent] + 1)
        far = self.jump[parent]
        again = self.depth[parent] - self.depth[far] == self.depth[far] - self.depth[self.jump[far]]
        self.jump.append(self.jump[far] if again else parent)

    def order(self, i: int, k: int, j: int, m: int) -> int:
        """-1 or 1 as the ids of prefix i with piece k come before or after those of prefix j with piece m; 0 if one begins the other."""
        depth, jump, parent, piece = self.depth, self.jump, self.parent, self.piece
        least = min(depth[i], depth[j])
        while depth[i] > least:
            far = jump[i]
            i, k = (far, -1) if depth[far] > least else (parent[i], piece[i])
        while depth[j] > least:
            far = jump[j]
            j, m = (far, -1) if depth[far] > least else (parent[j], piece[j])
        # a piece passed over by a jump isn't known, but the next step, which ends at the same depth, sets it
        if i == j:
            return (k > m) - (k < m)
        while True:
            far, off = jump[i], jump[j]
            if far != off:
                i, j = far, off
            elif parent[i] == parent[j]:
                return -1 if piece[i] < piece[j] else 1
            else:
                i, j = parent[i], parent[j]


def n_best(word: str, model: Model, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a word: (score, ids), the best first, equal scores in the order of ids."""
    if not word:
        return [(0.0, [])]
    ends, size = lattice(word, model), len(word)
    best, paths = [0.0], Paths()
    for edges in ends[1:]:
        top, start, piece = None, 0, 0
        for i, k, s in edges:
            reached = best[i] + s
            if top is None or reached > top or reached == top and paths.order(i, k, start, piece) < 0:
                top, start, piece = reached, i, k
        best.append(top)
        paths.add(start, piece)

    def whole(entry: tuple) -> list[tuple[int, int, int]]:
        """(start, stop, piece) of the entry's segmentation, from its end."""
        _, place, first, then, rest = entry
        own = [(place, then, first)]
        while place:
            own.append((paths.parent[place], place, paths.piece[place]))
            place = paths.parent[place]
        return own[::-1] + rest

    def before(a: tuple, b: tuple) -> bool:
        if a[0] != b[0]:
            return a[0] > b[0]
        at = paths.order(a[1], a[2], b[1], b[2])
        return at < 0 if at else [e[2] for e in whole(a)] < [e[2] for e in whole(b)]

    # (score of the whole, place, piece after the place's best prefix, where that piece stops, the edges after it)
    agenda: list[tuple] = [(best[size], paths.parent[size], paths.piece[size], size, [])]
    out: list[tuple[float, list[int]]] = []
    while agenda and len(out) < n:
        entry = agenda.pop(0)
        edges = whole(entry)
        out.append((entry[0], _ids(word, edges, model)))
        room, behind = n - len(out), 0.0
        # backwards from the entry's last own place: each other piece that ends at a place of its prefix is a new entry
        for at in range(len(edges) - 1, -1, -1):
            _, stop, piece = edges[at]
            if stop <= entry[1] or not out[1:]:
                for i, k, s in ends[stop]:
                    if k == piece and i == edges[at][0]:
                        continue
                    score = best[i] + s + behind
                    if len(agenda) == room and (not room or score < agenda[-1][0]):
                        continue
                    new = (score, i, k, stop, edges[at + 1 :])
                    place = len(agenda)
                    while place and before(new, agenda[place - 1]):
                        place -= 1
                    agenda.insert(place, new)
                    del agenda[room:]
            behind += model.unknown_score if piece == model.unknown else model.scores[piece]
    return out


def viterbi(word: str, model: Model) -> tuple[float, list[int], float]:
    """The best segmentation's score and ids, and by how much the second best one's score is less (infinite without one).

    Of equal scores the least ids count here in words of up to SHORT letters of which each is a piece; n_best sees to the others.
    """
    size, low = len(word), -math.inf
    best, second, back = [low] * (size + 1), [low] * (size + 1), [None] * (size + 1)
    best[0] = 0.0
    get, scores, ids, short = model.begins.get, model.scores, model.ids, size <= SHORT
    for i in range(size):
        here, other = best[i], second[i]
        if word[i] not in ids:
            _reach(best, second, back, i + 1, here + model.unknown_score, other + model.unknown_score, (i, model.unknown))
        for j in range(i + 1, size + 1):
            k = get(word[i:j])
            if k is None:
                break
            if k >= 0:
                reached = here + scores[k]
                if reached > best[j]:
                    next_ = other + scores[k]
                    second[j] = best[j] if best[j] > next_ else next_
                    best[j] = reached
                    back[j] = (i, k)
                elif reached >= second[j]:
                    second[j] = reached
                    if reached == best[j] and short and _prefix(back, i, k) < _prefix(back, *back[j]):
                        back[j] = (i, k)
    out, j = [], size
    while j:
        i, k = back[j]
        if k == model.unknown and model.bytes_:
            out += [model.bytes_[b] for b in reversed(word[i:j].encode())]
        else:
            out.append(k)
        j = i
    return best[size], out[::-1], best[size] - second[size]


class Steps:
    """The model's pieces as a tree of their beginnings, in arrays: a step leads from a node by a character to a node."""

    def __init__(self, model: Model):
        nodes = {"": 0} | {x: k for k, x in enumerate(model.begins, 1)}
        chars = {c: k for k, c in enumerate(sorted(model.chars), 1)}
        self.width = len(chars) + 1
        self.char = np.zeros(0x110000, np.int32)  # 0: not a piece by itself
        for c, k in chars.items():
            if c in model.ids:
                self.char[ord(c)] = k
        keys = np.array([nodes[x[:-1]] * self.width + chars[x[-1]] for x in model.begins], np.int64)
        # a hash table of the steps, at most a quarter full; where a slot is taken, the next one is tried
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == -1)
            self.keys[slot[free]], self.nodes[slot[free]] = keys[left[free]], left[free] + 1
            on = self.keys[slot] != keys[left]
            left, slot = left[on], slot[on] + 1 & len(self.keys) - 1
        self.piece = np.array([-1, *model.begins.values()], np.int32)
        self.inner = np.zeros(len(nodes), bool)
        self.inner[keys // self.width] = True
        self.scores = np.array(model.scores)
        self.beyond = np.ones(0x110000, bool)  # not in any piece
        self.beyond[[ord(c) for c in chars]] = False
        self.spelled, self.length = np.frombuffer(b"".join(model.spelled), np.uint8), np.array([len(x) for x in model.spelled])
        self.spell = np.cumsum(self.length) - self.length

    def step(self, node: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the steps there are, and the nodes that these lead to."""
        wanted = node * self.width + char
        slot = self.slot(wanted)
        held = self.keys[slot]
        to = self.nodes[slot]
        on = np.flatnonzero((held != wanted) & (held != -1))
        while len(on):
            slot[on] = slot[on] + 1 & len(self.keys) - 1
            held[on], to[on] = self.keys[slot[on]], self.nodes[slot[on]]
            on = on[(held[on] != wanted[on]) & (held[on] != -1)]
        there = np.flatnonzero(held == wanted)
        return there, to[there].astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)


def viterbi_many(words: list[str], model: Model) -> list[tuple[str, float, bytes, float]]:
    """viterbi for many words side by side: (word, score, packed ids, loss).

    Left out are words with a character that isn't a piece and words of several best segmentations, which need an order of ids.
    """
    steps = model.steps
    words = sorted(words, key=len, reverse=True)
    size = np.array([len(w) for w in words])
    char = steps.char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
    begin = np.cumsum(size) - size
    known = np.minimum.reduceat(char, begin) > 0
    base = begin + np.arange(len(words))  # a word of n characters has n + 1 places
    best = np.full(len(char) + len(words), -math.inf)
    second = best.copy()
    best[base] = 0.0
    back, piece, depth = (np.zeros(len(best), np.int32) for _ in range(3))
    for i in range(size[0]):
        word = np.arange(np.searchsorted(-size, -i))  # words of over i characters
        word = word[known[word]]
        node, j = np.zeros(len(word), np.int64), i
        while len(word):
            there, node = steps.step(node, char[begin[word] + j])
            word, j = word[there], j + 1
            k = steps.piece[node]
            ends = np.flatnonzero(k >= 0)
            w, k = word[ends], k[ends]
            here, to, s = base[w] + i, base[w] + j, steps.scores[k]
            reached, old = best[here] + s, best[to]
            better = reached > old
            second[to] = np.where(better, np.maximum(old, second[here] + s), np.maximum(second[to], reached))
            here, to = here[better], to[better]
            best[to], back[to], piece[to], depth[to] = reached[better], here, k[better], depth[here] + 1
            on = steps.inner[node] & (size[word] > j)
            word, node = word[on], node[on]
    last = base + size
    loss = np.where(known, best[last], 0.0) - second[last]
    keep = np.flatnonzero(known & (loss > 0))
    last, pieces = last[keep], depth[last[keep]]
    stop = np.cumsum(pieces)
    ids, at, to = np.empty(stop[-1] if len(keep) else 0, np.int32), last, stop - 1
    while len(at):
        ids[to] = piece[at]
        at = back[at]
        on = depth[at] > 0
        at, to = at[on], to[on] - 1
    raw, ends = ids.tobytes(), (4 * stop).tolist()
    parts = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return list(zip([words[k] for k in keep], best[last].tolist(), parts, loss[keep].tolist(), strict=True))


def _prefix(back: list, i: int, k: int) -> list[int]:
    """The ids up to place i, and k."""
    out = [k]
    while i:
        i, k = back[i]
        out.append(k)
    return out[::-1]


def _reach(best: list, second: list, back: list, j: int, reached: float, next_: float, edge: tuple[int, int]) -> None:
    if reached > best[j]:
        best[j], second[j], back[j] = reached, max(best[j], next_), edge
    else:
        second[j] = max(second[j], reached)


def _ids(word: str, edges: list[tuple[int, int, int]], model: Model) -> list[int]:
    out = []
    for start, stop, k in edges:
        if k == model.unknown and model.bytes_:
            out += [model.bytes_[b] for b in word[start:stop].encode()]
        else:
            out.append(k)
    return out


@dataclass
class Words:
    """Words (in UTF-32) with the score and the ids of their best segmentation, what the second best one's score is less, and when they were last asked for."""

    text: pa.LargeBinaryArray
    score: np.ndarray
    loss: np.ndarray
    size: np.ndarray
    ids: np.ndarray
    used: np.ndarray

    @staticmethod
    def of(text: pa.LargeBinaryArray, entries: list[tuple[float, bytes, float]]) -> Words:
        score, ids, loss = ([e[k] for e in entries] for k in range(3))
        return Words(text, np.array(score, float), np.array(loss, float), np.array([len(x) // 4 for x in ids], np.int64), np.frombuffer(b"".join(ids), np.int32), np.zeros(len(ids), np.int64))

    def __len__(self) -> int:
        return len(self.text)

    def __getitem__(self, k: int) -> str:
        return self.text[k].as_py().decode("utf-32-le")

    def begin(self) -> np.ndarray:
        """Where each word's ids begin."""
        return np.cumsum(self.size) - self.size

    def take(self, at: np.ndarray) -> Words:
        return Words(self.text.take(pa.array(at)), self.score[at], self.loss[at], self.size[at], _runs(self.ids, self.begin()[at], self.size[at]), self.used[at])

    def plus(self, other: Words) -> Words:
        both = lambda name: np.concatenate([getattr(self, name), getattr(other, name)])
        return Words(pa.concat_arrays([self.text, other.text]), *map(both, ("score", "loss", "size", "ids", "used")))


class Encoder:
    """Encodes whole texts, many together: each word that they have is looked up once. Words seen are kept up to a bound."""

    def __init__(self, model: Model, n: int = N_BEST, most: int = CACHE_WORDS):
        self.model, self.n, self.most = model, n, most
        self.cache, self.clock = Words.of(pa.array([], pa.large_binary()), []), 0
        self.alternatives: dict[str, list] = {}

    def cut(self, texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The texts' words in turn, in UTF-32, and how many there are to each text's end. Every segmentation cuts between them.

        A word is marks with what follows them, what follows a character that is in no piece, or such a character.
        """
        prefix = MARK if self.model.dummy_prefix else ""
        marked = [prefix + text.replace(" ", MARK) if text else "" for text in texts]
        size = np.array([len(x) for x in marked], np.int64)
        raw, stop = "".join(marked).encode("utf-32-le"), np.cumsum(size)
        code = np.frombuffer(raw, np.uint32)
        begins, mark = self.model.steps.beyond[code], code == ord(MARK)
        begins[1:] |= begins[:-1] | mark[1:] & ~mark[:-1]
        begins[(stop - size)[size > 0]] = True
        at = np.flatnonzero(begins)
        offsets = pa.py_buffer(4 * np.r_[at, len(code)].astype(np.int64))
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, offsets, pa.py_buffer(raw)]), np.searchsorted(at, stop)

    def words(self, text: str) -> pa.LargeBinaryArray:
        return self.cut([text])[0]

    def prepare(self, parts: list[pa.LargeBinaryArray]) -> tuple[Words, np.ndarray]:
        """The words of the arrays, with others, and the number of each in turn. New ones are made side by side and kept."""
        had = len(self.cache)
        coded = pa.concat_arrays([self.cache.text, *parts]).dictionary_encode()  # what is kept comes first, each word once
        number = coded.indices.to_numpy()[had:]
        words = self.cache.plus(Words.of(coded.dictionary[had:], self.made([w.decode("utf-32-le") for w in coded.dictionary[had:].to_pylist()])))
        self.clock += 1
        words.used[number] = self.clock
        keep = np.flatnonzero(np.diff(np.frombuffer(words.text.buffers()[1], np.int64, len(words) + 1, 8 * words.text.offset)) <= 4 * SHORT)
        if len(keep) > self.most // 2:
            keep = keep[np.argsort(-words.used[keep], kind="stable")[: self.most // 2]]
        self.cache = words if len(keep) == len(words) else words.take(keep)
        return words, number

    def made(self, words: list[str]) -> list[tuple[float, bytes, float]]:
        """(score, packed ids, loss of the second best) of each word."""
        short = [w for w in words if len(w) <= SHORT]
        found = {word: entry for word, *entry in viterbi_many(short, self.model)} if len(short) >= TOGETHER else {}
        return [found.get(w) or self.alone(w) for w in words]

    def alone(self, word: str) -> tuple[float, bytes, float]:
        score, ids, loss = viterbi(word, self.model)
        if loss == 0 and (len(word) > SHORT or any(c not in self.model.ids for c in word)):  # of equals, the one of the least ids
            ids = self.of_word(word)[0][1]
        return score, array("i", ids).tobytes(), loss

    def of_word(self, word: str) -> list[tuple[float, list[int]]]:
        """The word's n best segmentations."""
        found = self.alternatives.get(word)
        if found is None:
            found = n_best(word, self.model, self.n)
            if len(word) <= SHORT:
                if len(self.alternatives) >= self.most // 16:
                    self.alternatives.clear()
                self.alternatives[word] = found
        return found

    def places(self, losses: np.ndarray, parts: Callable[[int], str]) -> list[int]:
        """The words at which the n best segmentations of the text can differ from the best one; parts(k) is its word k.

        If a word isn't among the first n - 1 by what its second best costs (and then by the order of the texts' ids
        that result), they and the best one come before any segmentation that takes another of its pieces.
        """
        room = self.n - 1
        most = np.partition(losses, room - 1)[room - 1] if 0 < room < len(losses) else math.inf
        if most == math.inf:
            return np.flatnonzero(losses < most).tolist() if room else []
        chosen, equal = np.flatnonzero(losses < most).tolist(), np.flatnonzero(losses == most).tolist()
        room -= len(chosen)
        if len(equal) > room:
            # an alternative of lesser ids comes first where it stands early, one of greater ids where it stands late;
            # of equal scores the greater ids are the second best
            late = equal[::-1]
            if most > 0:
                lesser = {w: found[1][1] < found[0][1] for w in set(map(parts, equal)) for found in [self.of_word(w)]}
                early = [lesser[parts(k)] for k in equal]
                late = [k for k, x in zip(equal, early, strict=True) if x] + [k for k, x in zip(late, early[::-1], strict=True) if not x]
            equal = late[:room]
        return chosen + equal

    def combined(self, total: float, losses: np.ndarray, parts: Callable[[int], str]) -> list[tuple[float, dict[int, list[int]]]]:
        """The n best as (score, {word's place: its ids, where they aren't the best ones}); total is the best score."""
        chosen: list[tuple] = [(0.0, [], {})]
        for k in sorted(self.places(losses, parts)):
            found = self.of_word(parts(k))
            more = [(loss + found[0][0] - s, order + [ids], had | {k: ids} if r else had) for loss, order, had in chosen for r, (s, ids) in enumerate(found)]
            chosen = sorted(more, key=lambda x: x[:2])[: self.n]
        return [(total - loss, had) for loss, _, had in chosen]

    def changed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, list[tuple[int, int, list[int]]]]]]]:
        """The ids of the texts' best segmentations in turn, how many there are to each text's end, and for each text the n best as (score, what differs from the best).

        A difference is (at, n, ids): ids stand in place of the n ids from at on.
        """
        parts, until = self.cut(texts)
        words, number = self.prepare([parts])
        count, losses = words.size[number], words.loss[number]
        ids, stop = _runs(words.ids, words.begin()[number], count), np.r_[0, np.cumsum(count)]
        begin = np.r_[0, until[:-1]]
        totals = np.bincount(np.repeat(np.arange(len(texts)), until - begin), words.score[number], len(texts)).tolist()
        out = []
        for a, b, total in zip(begin.tolist(), until.tolist(), totals, strict=True):
            found = self.combined(total, losses[a:b], lambda k, a=a: words[number[a + k]])
            out.append([(s, [(int(stop[a + k] - stop[a]), int(count[a + k]), had[k]) for k in sorted(had)]) for s, had in found])
        return ids, stop[until], out

    def n_best(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text: (score, ids)."""
        ids, _, (found,) = self.changed([text])
        return [(s, applied(ids.tolist(), differences)) for s, differences in found]

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """What the ids of texts in turn spell; ends has how many there are to each text's end."""
        steps = self.model.steps
        size = steps.length[ids]
        raw, stop = _runs(steps.spelled, steps.spell[ids], size).tobytes(), np.r_[0, np.cumsum(size)][np.r_[0, ends]].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(stop, stop[1:], strict=False)]
        return [x[1:] if self.model.dummy_prefix and x.startswith(" ") else x for x in texts]


def _runs(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of runs in turn, each of a size from its begin on."""
    stop = np.cumsum(size)
    return values[np.repeat(begin - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]


def applied(ids: list[int], differences) -> list[int]:
    """The segmentation that differs so from the best one."""
    out, at = [], 0
    for begin, n, own in differences:
        out += [*ids[at:begin], *own]
        at = begin + n
    return out + ids[at:]


_ENCODERS: dict = {}


def _encoder(model, n: int, most: int) -> Encoder:
    """One encoder for each worker process and model: its cache serves the tasks that follow."""
    key = (getattr(model, "id", None), n, most)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Model.parse(model.value), n, most)
    return _ENCODERS[key]


#: n_best_changes has, for each of the n best, what differs from ids: the ids that stand in place of n ids from at on.
ENCODED = "ids array<int>, score double, n_best_scores array<double>, n_best_changes array<array<struct<at:int,n:int,ids:array<int>>>>, round_trip boolean"
CHANGES = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def _encode(model, n: int, most: int):
    """Adds to each row its n best segmentations, decodes the best one and says whether that gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, n, most)
        for batch in batches:
            column, end = batch.column("text"), 0
            while end < batch.num_rows:
                begin, end = end, _chunk(column, end)
                texts = [text or "" for text in column.slice(begin, end - begin).to_pylist()]
                yield _encoded(batch.column("rest").slice(begin, end - begin), texts, encoder)

    return run


def _chunk(column: pa.Array, row: int) -> int:
    """The row before which the texts from row on, one at least, have no more than CHUNK bytes."""
    size, end = len(column[row].as_buffer() or b""), row + 1
    while end < len(column) and (size := size + len(column[end].as_buffer() or b"")) <= CHUNK:
        end += 1
    return end


def _encoded(rest, texts: list[str], encoder: Encoder) -> pa.RecordBatch:
    change = lambda x: {"at": x[0], "n": x[1], "ids": x[2]}
    ids, ends, found = encoder.changed(texts)
    same = [x == text.replace(MARK, " ") for x, text in zip(encoder.decoded(ids, ends), texts, strict=True)]
    columns = {
        "rest": rest,
        "ids": pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids)),
        "score": pa.array([x[0][0] for x in found], pa.float64()),
        "n_best_scores": pa.array([[s for s, _ in x] for x in found], pa.list_(pa.float64())),
        "n_best_changes": pa.array([[list(map(change, y)) for _, y in x] for x in found], CHANGES),
        "round_trip": pa.array(same, pa.bool_()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _shared_model(docs: DataFrame, path: str | None):
    """The model's bytes for all executors: a vocabulary file of fixed size, read where the driver is."""
    spark = docs.sparkSession
    with open(path or spark.conf.get("factloom.sentencepiece.model", MODEL), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, path: str | None = None, n: int = N_BEST, most: int = CACHE_WORDS) -> DataFrame:
    """docs without text, with ids and score of the best segmentation, what differs in the n best, and whether ids decode to the text.

    most bounds the words that a worker keeps; it changes memory and time, not the rows.
    """
    docs = put_aside(docs, *[x.split()[0] for x in ENCODED.split(", ")])
    inner = docs.select(packed(docs, "text"), "text")
    done = bounded(inner).mapInArrow(_encode(_shared_model(docs, path), n, most), f"rest {inner.schema['rest'].dataType.simpleString()}, {ENCODED}")
    return done.select(*unpacked(docs, "text"), *[x.split()[0] for x in ENCODED.split(", ")])


def encoding_report(docs: DataFrame, path: str | None = None, n: int = N_BEST) -> DataFrame:
    """(doc_id, n_pieces, ids, score, n_best_scores, n_best_changes, round_trip) for each document."""
    found = encode_texts(docs.select("doc_id", "text"), path, n)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "score", "n_best_scores", "n_best_changes", "round_trip")
