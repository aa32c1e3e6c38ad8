r"""SentencePiece encoding and decoding by unigram Viterbi over a double-array trie.

The pieces come from a public model file, whose path is a parameter. Unigram models bring log scores; pieces of a
model trained by merging have ranks instead, and get ``-log(rank + 2)``, the log of a Zipf law up to a
constant. Encoding finds the segmentation with the largest sum of log scores (ties: the last piece
that starts earliest). A character that no piece starts with costs ``UNKNOWN`` less than the worst piece and
becomes its UTF-8 bytes where the model has byte pieces, else the unknown piece. A blank is written as the marker
U+2581 and one is put in front of a text if the model says so; decoding turns markers into blanks, byte pieces into
bytes, and takes the front marker off.

No piece of such a model runs on from another character into a marker (this is checked), so texts fall
apart into units: blanks with the word after them. Each distinct unit of a batch is segmented once, all
units together: numpy walks the trie from every character at once and then settles the best path by end
position. A model with a piece that spans units is segmented text by text in the same way.

The trie (three arrays of the size of the vocabulary) is broadcast; rows are encoded where they are, without
a shuffle.

Edge cases: null and empty texts have no tokens and decode to the empty text; a text's own U+2581 decodes to a
blank; invalid byte runs decode to U+FFFD; null ids, repeated rows and other columns are of no
consequence; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, table, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, UNKNOWN = "▁", 10.0
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1
#: Distinct units that a worker remembers before it starts anew.
REMEMBER = 400_000


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


def read_model(data: bytes) -> dict:
    """Pieces, scores and kinds, and the settings that bear on encoding."""
    pieces, scores, kinds, model = [], [], [], {"type": UNIGRAM, "byte_fallback": False, "front": True, "squeeze": True, "charsmap": b""}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            spec = dict(_fields(value))
            model |= {"type": spec.get(3, UNIGRAM), "byte_fallback": bool(spec.get(35, 0))}
        elif number == 3:
            spec = dict(_fields(value))
            model |= {"charsmap": spec.get(2, b""), "front": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1))}
    return model | {"pieces": pieces, "scores": scores, "kinds": kinds}


def log_scores(model: dict) -> list[float]:
    if model["type"] == UNIGRAM:
        return model["scores"]
    used = [i for i, kind in enumerate(model["kinds"]) if kind in (NORMAL, USER)]
    rank = {i: r for r, i in enumerate(used)}
    return [-math.log(rank[i] + 2) if i in rank else 0.0 for i in range(len(model["pieces"]))]


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value (the key's number, or -1) of a trie over bytes; state 0 is the root.

    The child of state s by byte c is base[s] + c + 1, if check there is s."""
    size = 1 << 16
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0], check[0], low = False, 0, 1
    todo = [(0, sorted((k, i) for i, k in enumerate(keys)), 0)]
    while todo:
        state, part, depth = todo.pop()
        children: dict[int, list] = {}
        for k, i in part:
            if len(k) == depth:
                value[state] = i
            else:
                children.setdefault(k[depth], []).append((k, i))
        if not children:
            continue
        codes = np.array(sorted(children)) + 1
        while True:
            if low + 8192 > size:
                base, check, value = (np.concatenate([x, np.full(size, f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
                free = np.concatenate([free, np.ones(size, bool)])
                size *= 2
            open_ = low + np.flatnonzero(free[low : low + 4096])
            low = int(open_[0])
            tried = open_[open_ >= codes[0]] - codes[0]
            fits = np.flatnonzero(free[tried[:, None] + codes].all(1))
            if len(fits):
                at = int(tried[fits[0]])
                break
            low += 2048  # a crowded stretch; what is free in it stays unused
        base[state] = at
        check[at + codes] = state
        free[at + codes] = False
        todo += [(at + c + 1, children[c], depth + 1) for c in children]
    end = int(np.flatnonzero(~free).max()) + 257
    return base[:end].copy(), check[:end].copy(), value[:end].copy()


class Tokenizer:
    def __init__(self, model: dict):
        if model["charsmap"]:
            raise ValueError("models with a normalisation map are not supported")
        pieces, kinds = model["pieces"], model["kinds"]
        self.front, self.squeeze = model["front"], model["squeeze"]
        self.unknown = kinds.index(UNK)
        scores = log_scores(model)
        chosen = [i for i, kind in enumerate(kinds) if kind in (NORMAL, USER)]
        self.base, self.check, number = double_array([pieces[i].encode() for i in chosen])
        self.piece_at = np.where(number >= 0, np.array([*chosen, -1])[number], -1)
        self.scores = np.array(scores)
        self.unknown_score = min([scores[i] for i in chosen], default=0.0) - UNKNOWN
        self.bytes = np.full(256, -1, np.int64)
        for i, kind in enumerate(kinds):
            if kind == BYTE:
                self.bytes[int(pieces[i][3:5], 16)] = i
        self.fallback = bool(model["byte_fallback"] and (self.bytes >= 0).all())
        self.output = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNK else p.replace(MARK, " ").encode() for p, kind in zip(pieces, kinds)]
        inner = [pieces[i] for i in chosen]
        # cutting before a run of markers is exact if no piece runs on into one, cutting at a line break if none has one
        cut_marks = not any(re.search(f"[^{MARK}]{MARK}", p) for p in inner)
        cut_lines = not any("\n" in p for p in inner)
        word = f"[^{MARK}\n]" if cut_lines else f"[^{MARK}]"
        self.units = re.compile(f"{MARK}*{word}+|{MARK}+" + ("|\n" if cut_lines else "")) if cut_marks else re.compile("(?s).+")
        self.known: dict[str, int] = {}
        self._forget()

    def _forget(self):
        self.known.clear()
        self.flat, self.first, self.sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.total = 0

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.front:
            text = " " + text
        return text.replace(" ", MARK)

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, number of ids of each)"""
        raw = [u.encode("utf-8", "replace") for u in units]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        size = np.array([len(r) for r in raw], np.int64)
        begin = np.cumsum(size) - size
        own = np.repeat(np.arange(len(raw)), size)
        start = np.flatnonzero((buf & 0xC0) != 0x80)
        stop = np.append(start[1:], len(buf))
        # all pieces from all characters: the trie is walked a byte at a time from every start that is still in it
        at, state, edges = start, np.zeros(len(start), np.int64), []
        limit, depth = (begin + size)[own[start]], 0
        single = np.zeros(len(buf) + 1, bool)
        char_end = np.zeros(len(buf), np.int64)
        char_end[start] = stop
        while len(at):
            inside = at + depth < limit
            at, state, limit = at[inside], state[inside], limit[inside]
            if not len(at):
                break
            after = self.base[state] + buf[at + depth] + 1
            good = self.check[after] == state
            at, state, limit = at[good], after[good].astype(np.int64), limit[good]
            depth += 1
            piece = self.piece_at[state]
            found = piece >= 0
            edges.append((at[found], at[found] + depth, piece[found]))
            single[at[found][char_end[at[found]] == at[found] + depth]] = True
        none = start[~single[start]]
        edges.append((none, char_end[none], np.full(len(none), -1)))
        low, high, piece = (np.concatenate(x) for x in zip(*edges))
        score = np.where(piece >= 0, self.scores[piece], self.unknown_score)
        # best path to each end, by distance of the end from the unit's beginning, in all units at once
        unit = own[low]
        reach = high - begin[unit]
        order = np.lexsort((low, high, reach))
        low, high, piece, score, reach, unit = low[order], high[order], piece[order], score[order], reach[order], unit[order]
        best, back, chosen = np.zeros(len(buf) + len(raw) + 1), np.zeros(len(buf) + len(raw) + 1, np.int64), np.zeros(len(buf) + len(raw) + 1, np.int64)
        source, target = low + unit, high + unit  # one more place a unit, for its end
        level = np.flatnonzero(np.diff(reach, prepend=-1))
        for i, j in zip(level.tolist(), [*level[1:].tolist(), len(reach)]):
            value = best[source[i:j]] + score[i:j]
            first = np.flatnonzero(np.diff(target[i:j], prepend=-1))
            top = np.maximum.reduceat(value, first)
            rank = np.where(value == np.repeat(top, np.diff(np.append(first, j - i))), np.arange(j - i), j)
            win = np.minimum.reduceat(rank, first) + i
            best[target[win]], back[target[win]], chosen[target[win]] = top, source[win], piece[win]
        # paths backwards, in all units at once
        here, units_at, first_place, steps = begin + size + np.arange(len(raw)), np.arange(len(raw)), begin + np.arange(len(raw)), []
        while len(here):
            live = here > first_place[units_at]
            here, units_at = here[live], units_at[live]
            if not len(here):
                break
            steps.append((units_at, chosen[here], back[here] - units_at, here - units_at))
            here = back[here]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(len(raw), np.int64)
        unit, piece, low, high = (np.concatenate(x[::-1]) for x in zip(*steps))
        order = np.argsort(low, kind="stable")
        unit, piece, low, high = unit[order], piece[order], low[order], high[order]
        wide = np.where((piece < 0) & self.fallback, high - low, 1)
        ids = np.repeat(np.where(piece < 0, self.unknown, piece), wide)
        if self.fallback:
            part = np.flatnonzero(np.repeat(piece < 0, wide))
            place = np.repeat(low - (np.cumsum(wide) - wide), wide) + np.arange(len(ids))
            ids[part] = self.bytes[buf[place[part]]]
        return ids.astype(np.int32), np.bincount(unit, weights=wide, minlength=len(raw)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)"""
        if len(self.known) > REMEMBER:
            self._forget()
        split = [self.units.findall(self.normalise(t)) if t else [] for t in texts]
        fresh = list(dict.fromkeys(u for units in split for u in units if u not in self.known))
        for i in range(0, len(fresh), 100_000):
            part = fresh[i : i + 100_000]
            ids, sizes = self.segment(part)
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))
            self.first.append(self.total + np.cumsum(sizes) - sizes)
            self.sizes.append(sizes)
            self.flat.append(ids)
            self.total += len(ids)
        if len(self.flat) > 1:
            self.flat, self.first, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.first)], [np.concatenate(self.sizes)]
        flat, first, sizes, known = self.flat[0], self.first[0], self.sizes[0], self.known
        number = np.array([known[u] for units in split for u in units], np.int64)
        n = sizes[number]
        place = np.repeat(first[number] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        many = np.array([len(u) for u in split], np.int64)
        edges = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(many)])]
        return flat[place], np.diff(edges)

    def decode(self, ids: list[int]) -> str:
        output = self.output
        text = b"".join([output[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.front and text.startswith(" ") else text




def load(spark, path: str = MODEL):
    """A broadcast of the parsed model; workers build the tokenizer from it once."""
    if "://" in path:
        data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    else:
        with open(path, "rb") as f:
            data = f.read()
    return spark.sparkContext.broadcast(Tokenizer(read_model(data)))


def encode(docs: DataFrame, path: str = MODEL, batch: int = 256) -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens and round_trip (whether decoding gives the text back)."""
    shared = load(docs.sparkSession, path)

    def run(batches):
        trim()
        tokenizer = shared.value
        is_byte = np.zeros(len(tokenizer.output), bool)
        is_byte[tokenizer.bytes[tokenizer.bytes >= 0]] = True
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                texts = part.column(1).to_pylist()
                ids, sizes = tokenizer.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                flat = ids.tolist()
                same = [tokenizer.decode(flat[x:y]) == (t or "") for t, x, y in zip(texts, offsets.tolist(), offsets[1:].tolist())]
                counted = np.concatenate([[0], np.cumsum(is_byte[ids])])[offsets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(sizes), pa.array(np.diff(counted)), pa.array(same, pa.bool_())],
                    ["doc_id", "ids", "n_tokens", "n_byte_tokens", "round_trip"],
                )

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of doc_id, ids (null ids: the empty text)."""
    shared = load(encoded.sparkSession, path)

    def run(batches):
        trim()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.decode([i for i in ids or [] if i is not None]) for ids in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    d = pick(encoded, "doc_id", "ids").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return d.mapInArrow(run, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
