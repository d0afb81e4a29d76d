"""BPE encoding and decoding with word ends, by prefix-sharing trie traversal.

A text is cut into pieces that no token crosses, by the tokenizer file's own normaliser and pattern. The distinct pieces
of a batch form a trie, which is walked depth first (their sorted order, with a stack for the path): each node holds the
last token of the encoding of the prefix that it stands for, so what pieces share at their front is computed once. The
last token of a prefix is the one token that ends there and may follow the last token of the shorter prefix; two tokens
may stand side by side if no merge across their border comes before those that made them. Which tokens end at a node is
read off a second trie, of the vocabulary: a node of the one remembers the longest path of the other that ends with it
(links to shorter endings as of Aho and Corasick). A word's last symbol carries the end-of-word suffix and is an edge of
its own, from the shared path.

A null text counts as empty: no tokens, the digests of nothing. Special tokens written out in a text become their ids,
as the file asks. Texts of any length are encoded whole; repeated rows one by one; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, tidy

KNOWN = 60_000  # pieces of one generation; a task remembers two, so frequent pieces stay
BORDERS = 250_000  # pairs of neighbouring tokens that a task remembers
RUN = 1 << 20  # characters of texts that are cut and encoded together

#: Texts of these characters only are cut by PIECE; of others, each chunk goes through the tokenizer file's own steps.
UNCOMMON = re.compile("[^\t\n\x0b\x0c\r -~¡§«°·»¿-įĲ-ňŊ-ž‐-―‘-‟…€]")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\sa-z0-9ß-öø-ž]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


class Vocabulary:
    """The trie of a vocabulary. ``inner[s]``: (length, id) of the tokens that end where path ``s`` ends, longest first; ``final[s]``: those with a word's end."""

    def __init__(self, ids: dict[str, int], end: str) -> None:
        self.down: list[dict[str, int]] = [{}]
        self.link = [0]
        self.inner: list[tuple[tuple[int, int], ...]] = [()]
        self.final: list[tuple[tuple[int, int], ...]] = [()]
        for token, i in ids.items():
            closed = bool(end) and token.endswith(end)
            body, at = token[: len(token) - len(end)] if closed else token, 0
            for c in body:
                at = self.down[at].setdefault(c, len(self.down))
                if at == len(self.down):
                    self.down.append({})
                    self.link.append(0)
                    self.inner.append(())
                    self.final.append(())
            if closed or not end:
                self.final[at] = ((len(body), i),)
            if not closed:
                self.inner[at] = ((len(body), i),)
        todo = [0]
        for at in todo:  # shorter paths first
            for c, below in self.down[at].items():
                if at:
                    self.link[below] = self.step(self.link[at], c)
                self.inner[below] += self.inner[self.link[below]]
                self.final[below] += self.final[self.link[below]]
                todo.append(below)

    def step(self, at: int, c: str) -> int:
        """The longest path that ends with path ``at`` and then ``c``."""
        down = self.down
        while (below := down[at].get(c)) is None:
            if not at:
                return 0
            at = self.link[at]
        return below


class TrieBpe:
    """Encoder and decoder for one tokenizer file (its JSON text)."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        conf = json.loads(spec)
        model = conf["model"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.ids.items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.rank = {(a, b): r for r, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.parts = {a + b: (r, a, b) for (a, b), r in self.rank.items()}
        self.trie = Vocabulary({t: i for t, i in self.ids.items() if t not in self.special}, self.end)
        self.packed = {i: struct.pack("<I", i) for i in self.token}
        self.shown = {i: t.encode() for i, t in self.token.items()}
        whole = Tokenizer.from_str(spec)
        self.normalizer, self.cutter = whole.normalizer, whole.pre_tokenizer
        self.symbol = _byte_symbols()
        self.byte = {s: b for b, s in self.symbol.items()}
        self.beside: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drop what was remembered; the tokenizer stays."""
        self.beside.clear()
        self.codes: dict[str, bytes] = {}  # ids of known pieces
        self.texts: dict[str, bytes] = {}  # and their decoded text
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def fits(self, left: str, right: str) -> bool:
        """May these two tokens be neighbours? Undo their merges, latest first, and look for an earlier one across the border."""
        limit = len(self.rank)
        while True:
            across = self.rank.get((left, right))
            if across is not None and across < limit:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]  # of equal merges, the one further left comes first

    def encode_pieces(self, pieces: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Distinct pieces (of byte symbols), sorted, with their ids."""
        beside, learn = self.beside, self._learn_border
        down, link, inner, final = self.trie.down, self.trie.link, self.trie.inner, self.trie.final
        # of the first d symbols on the path: path in the vocabulary's trie, last token of the encoding and its length
        states, path, sizes = [0], [0], [0]
        before = ""
        for piece in sorted(pieces):
            n, same = len(piece), 1
            for x, y in zip(piece, before):
                if x != y:
                    break
                same += 1
            del states[same:], path[same:], sizes[same:]
            d, at = len(states), states[-1]
            for c in piece[d - 1 :]:
                while (below := down[at].get(c)) is None and at:
                    at = link[at]
                at = below or 0
                for size, token in inner[at] if d < n else final[at]:
                    if size == d:
                        break
                    key = path[d - size] << 32 | token
                    if (ok := beside.get(key)) or (ok is None and learn(key)):
                        break
                else:
                    raise ValueError(f"no token ends at {d} of {piece!r}")
                if d < n:
                    states.append(at)
                    path.append(token)
                    sizes.append(size)
                d += 1
            found, d = [token], n - size
            while d:
                found.append(path[d])
                d -= sizes[d]
            found.reverse()
            yield piece, found
            before = piece

    def _learn_border(self, key: int) -> bool:
        if len(self.beside) > BORDERS:
            self.beside.clear()
        ok = self.beside[key] = self.fits(self.token[key >> 32], self.token[key & 0xFFFFFFFF])
        return ok

    def pieces(self, text: str) -> list[str]:
        """What no token crosses, in order."""
        if not UNCOMMON.search(text):
            return PIECE.findall(text.lower())
        out: list[str] = []
        for chunk in SPACE.findall(text):
            if UNCOMMON.search(chunk):
                out += [bytes(map(self.byte.__getitem__, p)).decode() for p, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]
            else:
                out += PIECE.findall(chunk.lower())
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known yet."""
        if len(self.codes) > KNOWN:
            self.older, self.codes, self.texts = (self.codes, self.texts), {}, {}
        codes, texts, (old_codes, old_texts), packed, shown = self.codes, self.texts, self.older, self.packed, self.shown
        new: dict[str, str] = {}
        for p in pieces.difference(codes):
            if p in old_codes:
                codes[p], texts[p] = old_codes[p], old_texts[p]
            else:
                new[p if p.isascii() and p.isprintable() else "".join(map(self.symbol.__getitem__, p.encode()))] = p
        for symbols, ids in self.encode_pieces(new):
            p = new[symbols]
            codes[p] = b"".join([packed[i] for i in ids])
            texts[p] = b" ".join([shown[i] for i in ids])

    def encode_batch(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids (little-endian, 32 bits) and decoded text of each text."""
        part: list[list[str]] = []
        size = 0
        for text in texts:
            whole = text.decode()
            # odd places hold special tokens
            cut = self.marks.split(whole) if self.marks and any(s in whole for s in self.special) else [whole]
            part.append([x for i, p in enumerate(cut) for x in ([_mark(p)] if i % 2 else self.pieces(p))] if len(cut) > 1 else self.pieces(whole))
            size += len(whole)
            if size > RUN:
                yield from self._looked_up(part)
                part, size = [], 0
        yield from self._looked_up(part)

    def _looked_up(self, part: list[list[str]]) -> Iterator[tuple[bytes, bytes]]:
        if not part:
            return
        pieces = set().union(*part)
        marks = {_mark(s) for s in self.special} & pieces
        self.learn(pieces - marks)
        code, text = self.codes, self.texts
        for m in marks:
            code[m], text[m] = self.packed[self.special[m[:-1]]], m[:-1].encode()
        for pieces in part:
            yield b"".join(map(code.__getitem__, pieces)), b" ".join(map(text.__getitem__, pieces))

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of ids, with a space between: the file names no decoder."""
        return " ".join(self.token[i] for i in ids if i in self.token)


def _mark(special: str) -> str:
    """A special token among pieces: they hold no white space."""
    return special + " "


def _byte_symbols() -> dict[int, str]:
    """The symbol of each byte: its own character where that prints, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _worker_encoder(spec: str) -> TrieBpe:
    """One encoder for a worker process, which outlives a task; what it remembers is bounded and goes when the task ends."""
    home = sys.modules.setdefault("_tessera_bpe", types.ModuleType("_tessera_bpe"))
    key = hashlib.sha256(spec.encode()).hexdigest()
    if getattr(home, "key", None) != key:
        home.key, home.encoder = key, TrieBpe(spec)
    return home.encoder


def _encoded(spec, keep_ids: bool) -> Callable:  # noqa: ANN001 (a broadcast)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(spec.value)
        encoder.forget()
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            n, ids, sha, decoded = [], [], [], []
            for code, text in encoder.encode_batch(texts):
                n.append(len(code) // 4)
                sha.append(hashlib.sha256(code).hexdigest())
                decoded.append(hashlib.sha256(text).hexdigest())
                if keep_ids:
                    ids.append(code)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(decoded, pa.string()), *([pa.array(ids, pa.binary())] if keep_ids else [])], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])])

        encoder.forget()

    return run


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids themselves (32 bits each, little-endian)."""
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a tokenizer file: its size is fixed
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")
    return rows.mapInArrow(tidy(_encoded(spec, keep_ids)), schema).withColumnRenamed("id", id_col)
