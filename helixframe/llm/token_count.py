"""Token counts by a finite-state transducer that is compiled from a tokenizer file.

The tokenizer's split and its merges never cross ASCII white space, so a text is read by a deterministic transducer over
bytes: a resting state between words, a state for each prefix of a word, one transition for each byte. White space leads
from any state back to rest, and that transition emits the number of tokens of the word it closes. States and transitions
are compiled when first needed and kept in flat tables of bounded size, which are started anew when full; many words take
a step at once.

What a closing transition emits is compiled from the file's vocabulary and merges: words are normalised and split by the
file's own rules, and the merges run side by side over all new pieces. Only words that hold a special string of the file, or
pieces longer than `LONG` bytes, are given to the library as wholes.

A chunk cut anywhere is a map from states to states and counts: what closes the word left open on its left (head: the entry
state's word goes on with it), the tokens of the words that lie wholly inside, and the word left open on its right (tail: the
exit state, named by its prefix). Such maps compose associatively, so chunks of one text are read in parallel by
different tasks, and a scan of levels joins `FAN` neighbouring maps at a time until each text has one.

Null and empty texts have no tokens; very long ones are chunks like others, whatever their words' length. Ids may be null or
repeated; repeated rows count as one row each. An empty table gives an empty one. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

from .common import Words, byte_hashes, mix, per_doc, slices, word_table  # noqa: E402

CHUNK_BYTES, FAN = 1 << 18, 128
MAX_STATES = 1 << 21
LONG = 256
_SPACE = word_table("space")
_BATCH = 1 << 14
_compiled: dict[str, Transducer] = {}


class Merges:
    """Byte-pair merges of a tokenizer file, run over many pieces at once; a piece's last symbol bears the end-of-word mark."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("the file's model is not plain byte-pair encoding")
        vocabulary, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        a, b, c = (np.array([vocabulary[x] for x in side], np.int64) for side in ([p[0] for p in pairs], [p[1] for p in pairs], [p[0] + p[1] for p in pairs]))
        key = (a << 32) | b
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.merged = key[order], order, c[order]
        self.inner, self.last = (np.full(1 + max(map(ord, (x for x in vocabulary if len(x) == 1))), -1, np.int64) for _ in range(2))
        for x in (x for x in vocabulary if len(x) == 1):
            self.inner[ord(x)], self.last[ord(x)] = vocabulary[x], vocabulary[x + end]

    def counts(self, pieces: list[str]) -> np.ndarray:
        """How many tokens each piece (not empty) has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out, never = np.zeros(len(pieces), np.int64), len(self.key)
        chars = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        sym = self.inner[chars]
        at_end = np.cumsum(size) - 1
        sym[at_end] = self.last[chars[at_end]]
        word = np.repeat(np.arange(len(pieces)), size)
        while len(sym):
            pair = (sym[:-1] << 32) | sym[1:]
            place = np.minimum(np.searchsorted(self.key, pair), never - 1)
            rank = np.full(len(sym), never, np.int64)
            rank[:-1] = np.where((self.key[place] == pair) & (word[:-1] == word[1:]), self.rank[place], never)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            n = np.diff(np.append(first, len(sym)))
            open_ = least < never
            out[word[first[~open_]]] = n[~open_]
            take = (rank == np.repeat(least, n)) & (rank < never)
            at = np.flatnonzero(take)
            run = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            sym[at] = self.merged[place[at]]
            keep = np.repeat(open_, n)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        return out


class Transducer:
    """States by number, 0 at rest; transitions by (state, byte) in an open-addressing table; emitted counts by the state that a word closes in."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        self.tokenizer, self.max_states = Tokenizer.from_file(path), max_states
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(len(t.split()) != 1 for t in self.special):
            raise ValueError("a special string holds white space")
        self._start()

    def _start(self) -> None:
        self.mask = 2 * (1 << (self.max_states - 1).bit_length()) - 1
        self.edge, self.to = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        self.emits, self.states = np.full(self.max_states, -1, np.int32), 1
        self.known: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> Transducer:
        if path not in _compiled:
            _compiled[path] = cls(path)
        return _compiled[path]

    def _slots(self, edges: np.ndarray) -> np.ndarray:
        """The slot of each edge: its own, or the free one where it belongs."""
        slot = (mix(edges.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)
        todo = np.arange(len(edges))
        while len(todo):
            held = self.edge[slot[todo]]
            todo = todo[(held != edges[todo]) & (held >= 0)]
            slot[todo] = (slot[todo] + 1) & self.mask
        return slot

    def read(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The state that each word ends in; -1 where a transition is not compiled."""
        state, live = np.zeros(len(starts), np.int64), np.arange(len(starts))
        depth = 0
        while len(live):
            edges = (state[live] << 8) | data[starts[live] + depth]
            slot = self._slots(edges)
            found = self.edge[slot] == edges
            state[live] = np.where(found, self.to[slot], -1)
            depth += 1
            live = live[found & (ends[live] - starts[live] > depth)]
        return state

    def _grow(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> None:
        """Compile the states and transitions of new words, and what closing them emits."""
        if self.states + int((ends - starts).sum()) > self.max_states:
            self._start()
            room = np.cumsum(ends - starts) < self.max_states - 1
            starts, ends, counts = starts[room], ends[room], counts[room]
        state, live, depth = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
        while len(live):
            edges = (state[live] << 8) | data[starts[live] + depth]
            new = np.unique(edges)
            new = new[self.edge[self._slots(new)] != new]
            names = np.arange(self.states, self.states + len(new), dtype=np.int32)
            while len(new):
                slot = self._slots(new)
                self.edge[slot] = new
                own = self.edge[slot] == new
                self.to[slot[own]] = names[own]
                new, names = new[~own], names[~own]
            self.states = max(self.states, int(self.to[self._slots(edges)].max()) + 1)
            state[live] = self.to[self._slots(edges)]
            depth += 1
            live = live[ends[live] - starts[live] > depth]
        self.emits[state] = counts

    def compile(self, words: list[bytes]) -> np.ndarray:
        """The tokens of whole words: the file's normaliser and split, then its merges."""
        text = [w.decode() for w in words]
        odd = np.array(["\0" in t or len(t) > LONG or any(x in t for x in self.special) for t in text], bool)
        out = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(odd).tolist():
            out[i] = len(self.tokenizer.encode(text[i], add_special_tokens=False).ids)
        plain = np.flatnonzero(~odd)
        for at in range(0, len(plain), _BATCH):
            part = plain[at : at + _BATCH]
            joined = " \0 ".join([text[i] for i in part.tolist()])
            if self.tokenizer.normalizer:
                joined = self.tokenizer.normalizer.normalize_str(joined)
            pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(joined)]
            bound = np.fromiter((p == _NUL for p in pieces), bool, len(pieces))
            fresh = list({p for p in pieces if p not in self.known and p != _NUL})
            self.known |= zip(fresh, self.merges.counts(fresh).tolist())
            n = np.fromiter((0 if p == _NUL else self.known[p] for p in pieces), np.int64, len(pieces))
            out[part] = np.bincount(np.cumsum(bound), n, minlength=len(part)).astype(np.int64)
            if len(self.known) > self.max_states:
                self.known = {}
        return out

    def closing(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The tokens of words that differ from each other."""
        state = self.read(data, starts, ends)
        out = np.where(state >= 0, self.emits[state], -1).astype(np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            raw = data.tobytes()
            out[new] = self.compile([raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())])
            short = new[ends[new] - starts[new] <= LONG]
            self._grow(data, starts[short], ends[short], out[short])
        return out

    def emit(self, w: Words) -> np.ndarray:
        """The tokens that each word of some texts emits; equal words are read once."""
        hashes, proofs = byte_hashes(w.data, w.starts, w.ends)
        u, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        out = self.closing(w.data, w.starts[first], w.ends[first])[inverse] if len(u) else np.zeros(0, np.int64)
        twin = np.flatnonzero(proofs != proofs[first][inverse]) if len(u) else ()
        for i in twin:  # different words of equal hash
            out[i] = self.closing(w.data, w.starts[i : i + 1], w.ends[i : i + 1])[0]
        return out

    def word(self, w: bytes) -> int:
        data = np.frombuffer(w, np.uint8)
        return int(self.closing(data, np.zeros(1, np.int64), np.array([len(w)]))[0]) if w else 0


#: How the byte-level alphabet spells the byte 0.
_NUL = chr(256)

Map = tuple[bool, bytes, int, bytes]


def state_map(t: Transducer, chunk: bytes) -> Map:
    """(has white space, head, tokens inside, tail) of a chunk; without white space the whole chunk is head."""
    data = np.frombuffer(chunk, np.uint8)
    w = Words(data, np.array([0, len(data)]), _SPACE)
    n = len(w.starts)
    if n == 0:
        return bool(chunk), b"", 0, b""
    left, right = w.starts[0] == 0, w.ends[-1] == len(data)
    if left and right and n == 1:
        return False, chunk, 0, b""
    inside = slice(int(left), n - int(right))
    head = chunk[: w.ends[0]] if left else b""
    tail = chunk[w.starts[-1] :] if right else b""
    w.starts, w.ends = w.starts[inside], w.ends[inside]
    return True, head, int(t.emit(w).sum()), tail


def compose(t: Transducer, maps: list[Map]) -> Map:
    """The map of neighbouring chunks in order."""
    open_word, head, total = [], None, 0
    for cut, left, inside, right in maps:
        open_word.append(left)
        if cut:
            w = b"".join(open_word)
            if head is None:
                head = w
            else:
                total += t.word(w)
            total += inside
            open_word = [right]
    w = b"".join(open_word)
    return (False, w, 0, b"") if head is None else (True, head, total, w)


def tokens_of(t: Transducer, m: Map) -> int:
    """What a whole text's map emits from rest to rest."""
    return t.word(m[1]) + m[2] + t.word(m[3])


_MAP = "struct<cut:boolean,head:binary,inside:bigint,tail:binary>"


def _columns(maps: list[Map]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([m[i] for m in maps], kind) for i, kind in enumerate((pa.bool_(), pa.binary(), pa.int64(), pa.binary()))], ["cut", "head", "inside", "tail"])


def _tuple(m: dict) -> Map:
    return m["cut"], m["head"], m["inside"], m["tail"]


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    Texts of one chunk need no shuffle; only chunks of longer ones are dealt out and meet again as state maps, `fan` at a time.
    """

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        t, parts = Transducer.load(path), [np.zeros(0, np.int64)]
        for _, _, w in slices(texts, _SPACE):
            parts.append(per_doc(t.emit(w), w.first))
        return pa.array(np.concatenate(parts), pa.int64())

    @F.arrow_udf(_MAP)
    def read(chunks: pa.Array) -> pa.Array:
        t = Transducer.load(path)
        return _columns([state_map(t, c.as_buffer().to_pybytes()) for c in chunks])

    @F.arrow_udf(_MAP)
    def join(rows: pa.Array) -> pa.Array:
        t = Transducer.load(path)
        return _columns([compose(t, [_tuple(m.as_py()) for m in r.values]) for r in rows])

    @F.arrow_udf("bigint")
    def close(maps: pa.Array) -> pa.Array:
        t = Transducer.load(path)
        return pa.array([tokens_of(t, _tuple(m.as_py())) for m in maps], pa.int64())

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("n", F.octet_length("text").cast("long"))
    short = rows.filter(F.col("n") <= chunk_bytes).select("id", "n", count("text").alias("tokens"))
    long = rows.filter(F.col("n") > chunk_bytes).withColumn("row", F.monotonically_increasing_id()).withColumn("raw", F.encode("text", "utf-8"))
    at = F.expr(f"sequence(0L, n - 1, {chunk_bytes}L)")
    parts = long.select("id", "n", "row", F.posexplode(at).alias("k", "at"), "raw").select("id", "n", "row", "k", F.substring(F.col("raw"), F.col("at").cast("int") + 1, F.lit(chunk_bytes)).alias("part"))
    maps, most = parts.select("id", "n", "row", "k", read("part").alias("m")), -(-(1 << 31) // chunk_bytes)
    while most > 1:
        near = maps.groupBy("id", "n", "row", F.floor(F.col("k") / fan).cast("int").alias("up")).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("ms"))
        maps, most = near.select("id", "n", "row", F.col("up").alias("k"), join(F.expr("transform(ms, x -> x.m)")).alias("m")), -(-most // fan)
    scanned = maps.select("id", "n", close("m").alias("tokens"))
    return short.unionByName(scanned).select(F.col("id").alias(id_col), F.col("n").alias("n_bytes"), F.col("tokens").alias("n_tokens"), (F.col("tokens") > limit).alias("over_limit"))
