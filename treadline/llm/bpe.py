"""Byte-pair encoding by a bounded-lookahead streaming transducer, and decoding by a byte-to-text state machine.

**Encoding.** For a list of ranked merges, a sequence of tokens is the encoding of its symbols exactly if each two neighbours
are the encoding of their own symbols. So each prefix of a word has one last token, found by trying the tokens that end there against the last
token of the prefix before them. A later symbol can only change what lies behind the last boundary on which all *live* boundaries agree:
those from which a token may still reach past the symbols read. Tokens before that boundary are stable: the transducer emits them
and forgets their symbols. :attr:`Merges.lookahead` bounds from the merge list alone how much it has to keep, and is the length at which it looks
for the boundary, so the work per symbol stays constant too.

**Decoding.** Tokens give bytes, and an incremental UTF-8 machine turns bytes into text, whatever the cuts between the pieces that are fed to it.
"""
from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treadline.llm.common import worker_cache

#: Entries of the tables that spare work; they bound memory and never change a result.
PAIRS, WORDS, LONGEST_KEPT, STATES = 1 << 17, 1 << 17, 48, 1 << 17
#: Texts are read in pieces of about this many letters, cut at white space.
SLICE = 1 << 16
#: The key of a token in the tree of spellings; symbols are 0 to 511.
TOKEN = -1
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {}, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


class Merges:
    """A ranked merge list over bytes, with other symbols for the last byte of a word. Symbol 256 + b is byte b at a word's end."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        self.symbol_id: dict[str, int] = {}
        spelled: dict[str, str] = {}
        for b, letter in enumerate(byte_letters()):
            for name, symbol in ((letter, chr(b)), (letter + end, chr(256 + b))):
                if name in vocab:
                    spelled[name] = symbol
                    self.symbol_id[symbol] = vocab[name]
        self.rule: dict[tuple[int, int], tuple[int, int]] = {}
        parts = []
        for rank, (left, right) in enumerate(merges):
            self.rule.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
            spelled.setdefault(left + right, spelled[left] + spelled[right])
            parts.append((vocab[left], vocab[right], vocab[left + right], len(spelled[right])))
        self.spelling = {vocab[name]: s for name, s in spelled.items()}
        #: Tokens that the merges make of their own symbols; only these are ever emitted.
        self.token = {s: i for i, s in self.spelling.items() if len(s) == 1 or self.merge(s) == [i]}
        self.tree: dict = {}
        for spelling, i in self.token.items():
            node = self.tree
            for c in spelling:
                node = node.setdefault(ord(c), {})
            node[TOKEN] = i
        self.lookahead = self._lookahead(parts)
        self.fit = _Pairs(self)

    def merge(self, symbols: str) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.symbol_id[c] for c in symbols]
        while len(ids) > 1:
            best = min(((self.rule[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rule), default=None)
            if best is None:
                break
            k = best[1]
            ids[k:k + 2] = [self.rule[ids[k], ids[k + 1]][1]]
        return ids

    @staticmethod
    def _lookahead(parts: list[tuple[int, int, int, int]]) -> int:
        """How many symbols behind a boundary can decide whether it is one.

        A merge across it reads its right part. That part can be kept from forming only by a merge of lower rank which takes
        a token of its right edge, and that one by another of still lower rank, so chains of rules with falling ranks are added up.
        """
        edge: dict[int, tuple[int, ...]] = {}
        reach: dict[int, int] = {}
        for left, right, made, length in parts:
            edge[made] = (*edge.get(right, (right,)), made)
            far = length + max(reach.get(t, 0) for t in edge.get(right, (right,)))
            reach[left] = max(reach.get(left, 0), far)
        return max(reach.values(), default=0)


class _State(dict):
    """What the symbols read so far leave open: the live boundaries. As a table, symbol -> (next state, token that ends here, its length).

    A live boundary is (how many symbols back it lies, the place in the tree of spellings that is reached from it, the token that ends at it).
    None of these depends on where in a word they occur, so a move is found once and then looked up.
    """

    __slots__ = ("live", "transducer")

    def __init__(self, live: tuple, transducer: Transducer) -> None:
        self.live, self.transducer = live, transducer

    def __missing__(self, symbol: int) -> tuple[_State | None, int, int]:
        fit, found, length, on = self.transducer.merges.fit, -1, 0, []
        for back, node, before in self.live:
            node = node.get(symbol)
            if node is not None:
                token = node.get(TOKEN)
                if token is None or len(node) > 1:
                    on.append((back + 1, node, before))
                if found < 0 and token is not None and (before < 0 or fit[before << 32 | token]):
                    found, length = token, back + 1
        if found < 0:
            raise ValueError("no token ends here: the vocabulary lacks a byte")
        on.append((0, self.transducer.merges.tree, found))
        # Nothing is read after the last symbol of a word.
        move = self[symbol] = (self.transducer.state(tuple(on)) if symbol < 256 else None, found, length)
        return move


class Transducer:
    """Encodes the bytes of one word; ``feed`` takes them in pieces and yields ids, as little-endian 32-bit integers, once they are stable.

    States and their moves are made as words need them and forgotten when there are ``STATES``.
    """

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.window = merges.lookahead + max(map(len, merges.token))
        self.most_kept = 0
        self.states: dict[tuple, _State] = {}
        self.first = _State(((0, merges.tree, -1),), self)

    def state(self, live: tuple) -> _State:
        key = tuple([(back, id(node), before) for back, node, before in live])
        state = self.states.get(key)
        if state is None:
            if len(self.states) >= STATES:
                for old in self.states.values():
                    old.clear()
                self.states.clear()
                self.first.clear()
            state = self.states[key] = _State(live, self)
        return state

    def word(self, word: bytes) -> bytes:
        if len(word) > 2 * self.window:
            return b"".join(self.feed((word,)))
        if not word:
            return b""
        state, tokens, lengths = self.first, [-1], [0]
        for symbol in word[:-1]:
            state, token, length = state[symbol]
            tokens.append(token)
            lengths.append(length)
        _, token, length = state[256 + word[-1]]
        tokens.append(token)
        lengths.append(length)
        return self._ids(tokens, lengths, len(word))

    def feed(self, pieces: Iterable[bytes]) -> Iterator[bytes]:
        # Position 0 is the last stable boundary; tokens[p] ends at p and lengths[p] is its length.
        state, tokens, lengths = self.first, [-1], [0]
        held = -1
        for piece in pieces:
            for byte in piece:
                if held >= 0:
                    state, token, length = state[held]
                    tokens.append(token)
                    lengths.append(length)
                    if len(tokens) > 2 * self.window:
                        self.most_kept = max(self.most_kept, len(tokens))
                        ready, tokens, lengths = self._settle(state, tokens, lengths)
                        yield ready
                held = byte
        if held >= 0:
            _, token, length = state[256 + held]
            tokens.append(token)
            lengths.append(length)
            yield self._ids(tokens, lengths, len(tokens) - 1)

    @staticmethod
    def _ids(tokens: list[int], lengths: list[int], at: int) -> bytes:
        ids = []
        while at:
            ids.append(tokens[at])
            at -= lengths[at]
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def _settle(self, state: _State, tokens: list[int], lengths: list[int]) -> tuple[bytes, list[int], list[int]]:
        """Emit what lies before the last boundary that all live ones share. If there is none yet, nothing is emitted and all is kept."""
        last = len(tokens) - 1
        heads = {last - back for back, _, _ in state.live}
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(top - lengths[top])
        at = heads.pop()
        # Lengths that reach back past the new position 0 belong to boundaries that no live one goes through.
        return self._ids(tokens, lengths, at), tokens[at:], lengths[at:]


class _Pairs(dict):
    """Whether two tokens are the encoding of their own symbols, in a table of bounded size."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges

    def __missing__(self, key: int) -> bool:
        pair = [key >> 32, key & 0xFFFFFFFF]
        if len(self) >= PAIRS:
            self.clear()
        fits = self[key] = self.merges.merge("".join(self.merges.spelling[t] for t in pair)) == pair
        return fits


class _Kept(dict):
    """What ``make`` gives for a key, kept for short keys in two tables of bounded size: a full one becomes the older one."""

    def __init__(self, make) -> None:
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        made = self.older.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = made
        return made


class Encoder:
    """Text to ids as the vocabulary file prescribes: NFC, lower case, the file's split into words, then merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        kinds = [x["type"] for x in made["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only BPE files with word ends that compose, replace white space and fold case are known here")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.transducer = Transducer(Merges(model["vocab"], pairs, model["end_of_word_suffix"]))
        split = next(x for x in made["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in made["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks, self.known = _Kept(self.chunk), _Kept(lambda w: self.transducer.word(w.encode()))
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        #: What stands for each id: its name, and its bytes in running text.
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        byte = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
        end = model["end_of_word_suffix"]
        whole = set(self.special.values())

        def plain(i: int) -> bytes:
            name = names.get(i, "")
            stem, tail = (name[:-len(end)], b" ") if name.endswith(end) and len(name) > len(end) else (name, b"")
            return name.encode() if i in whole else b"".join(byte.get(c, c.encode()) for c in stem) + tail
        self.plain = [plain(i) for i in range(len(self.names))]

    def _words(self, chunk: str) -> str:
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        # Case is folded letter by letter: no final sigma.
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run of text without white space."""
        known = self.known
        return b"".join([known[w] for w in self.words.findall(self._words(chunk))])

    def _ordinary(self, text: str, at: int, end: int) -> Iterator[bytes]:
        kept = self.chunks
        while at < end:
            space = _SPACE.search(text, at + SLICE, end) if end - at > SLICE else None
            to = space.start() if space else end
            part = text[at:to]
            chunks = part.split() if not _ODD_SPACE.search(part) else [c for c in _SPACE.split(part) if c]
            if len(part) <= 2 * SLICE:
                yield b"".join([kept[c] for c in chunks])
            else:
                for c in chunks:
                    if len(c) <= SLICE:
                        yield kept[c]
                    else:
                        for m in self.words.finditer(self._words(c)):
                            yield from self.transducer.feed(m[0][i:i + SLICE].encode() for i in range(0, len(m[0]), SLICE))
            at = to

    def pieces(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, piece by piece. Special tokens in the text are read as such."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield from self._ordinary(text, at, m.start())
            yield struct.pack("<I", self.special[m[0]])
            at = m.end()
        yield from self._ordinary(text, at, len(text))

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(self.pieces(text))


class Decoder:
    """Bytes of tokens to text, in pieces of any size. ``names``: tokens by name with a space between, as the library prints them."""

    def __init__(self, encoder: Encoder, names: bool = False) -> None:
        self.table, self.between = (encoder.names, b" ") if names else (encoder.plain, b"")
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def feed(self, ids: np.ndarray) -> str:
        table = self.table
        data = self.between.join([table[i] for i in ids.tolist()])
        if len(ids):
            data = data if self.first else self.between + data
            self.first = False
        return self.machine.decode(data)

    def end(self) -> str:
        """What bytes without an end become."""
        return self.machine.decode(b"", True)


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, piece: int = 1 << 16) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and with ``keep_ids`` the ``ids`` and their text ``decoded``.

    A row-wise step without a shuffle. ``path`` names the vocabulary file on the executors. Null and empty texts give no ids. Texts of any length
    are encoded in pieces, hashed and decoded as their tokens become stable, at most ``piece`` ids at a time; beside the text itself and, in a run without white
    space, its lower-case form, nothing is held that grows with its length. Repeated rows give equal results. Only id and text are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(("bpe", path), lambda: Encoder(path))
        for batch in batches:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if keep_ids else {})
            for text in batch.column(1):
                count, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                decoder, plain, whole, texts = Decoder(encoder, names=True), Decoder(encoder), [], []
                for ids in encoder.pieces(text.as_py() or ""):
                    of_ids.update(ids)
                    array = np.frombuffer(ids, "<u4")
                    count += len(array)
                    for at in range(0, len(array), piece):
                        of_text.update(decoder.feed(array[at:at + piece]).encode())
                        if keep_ids:
                            texts.append(plain.feed(array[at:at + piece]))
                    if keep_ids:
                        whole.append(array)
                of_text.update(decoder.end().encode())
                out["n_tokens"].append(count)
                out["ids_sha256"].append(of_ids.hexdigest())
                out["decoded_sha256"].append(of_text.hexdigest())
                if keep_ids:
                    out["ids"].append(np.concatenate([np.empty(0, "<u4"), *whole]).astype(np.int32))
                    out["decoded"].append("".join([*texts, plain.end()]))
            columns = [batch.column(0), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()),
                       pa.array(out["decoded_sha256"], pa.string())]
            if keep_ids:
                columns += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["decoded"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_name, *out])

    id_name, kind = id_col, dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
