"""Token ids in files of Simple-8b words, written and read in the order of the documents.

*Code.*  A 64-bit word holds a selector in its top 4 bits and as many ids as
fit below it: 60 of 1 bit, 30 of 2, ... 3 of 20, 1 of 60; two selectors stand
for runs of 240 and 120 zeros.  The last selector's greatest payload is an
escape: the id follows in a word of its own.  Each word takes as many ids as
fit.  Coding goes in blocks of BLOCK ids whose word offsets are kept, so that
all blocks are coded side by side and any block can be read alone.

*Files.*  A file image is: magic, counts, the key, length and null mark of each
document, block offsets, words.  It is self-contained and checked when read.
Images are rows of a Parquet table, because its commit protocol survives lost
executors and works on any store that Spark can write. ``read_documents`` reads
some documents of an image by decoding only the blocks they lie in.

*Order.*  Texts are encoded where they lie, and only the packed ids are
shuffled: to key ranges found by quantiles, each sorted and cut into files of
about FILE_IDS ids.  A document's start is its place in the file, plus the
files before it in the range, plus the ranges before it, so no task sees more
than its range.

Defined cases: null and empty text have the end id alone; null keys come first;
of repeated keys the order is by ids, and equal rows are interchangeable; an
empty table gives an empty result; only key and text are read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sextant.llm import flatwords
from sextant.scratch import materialize

if TYPE_CHECKING:
    from tokenizers import Tokenizer

END_ID = 0
BLOCK = 4096
FILE_IDS = 500_000
#: Documents in a key range, about; ranges are at least as many as shuffle partitions.
RANGE_ROWS = 200_000
#: Pieces a worker process knows at most, about; the half used last stays when they are more.
SEEN = 2_000_000
CHARACTERS = 2_000_000
#: Pieces of text that go through one call of the library.
JOINT = 5_000

#: Ids per word and bits per id by selector; the first two are runs of zeros.  Fixed values of the code.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = np.uint64((1 << 60) - 1)
_PAYLOAD = np.uint64((1 << 60) - 1)
_BITS = np.frexp(np.arange(1 << 16))[1].astype(np.int8)
MAGIC = b"S8B1"

# -- code --------------------------------------------------------------------


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks in order, and the offset of each block's first word (one more than blocks)."""
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    width = np.full(blocks * block, 127, np.int8)  # what follows the last id is wider than any selector takes
    # Bits of each id; one more is possible beyond 53, where 60 follow.
    width[:n] = _BITS[ids] if ids.dtype == np.uint16 else np.frexp(ids.astype(np.float64))[1]
    ids = ids.astype(np.uint64)
    # The selector at each place: the first whose run of ids is all narrow enough and inside the block. Where one
    # fits all later ones do, so those that fit are counted. The widest of a run is that of a shorter run from its
    # start and of one to its end.
    choice = np.full((blocks, block), 15, np.int8)
    widest, run = width.reshape(blocks, block), 1
    for s in range(14, -1, -1):
        more = int(COUNTS[s]) - run
        if run + more > block:
            break
        widest, run = np.maximum(widest[:, :-more], widest[:, more:]), run + more
        fits = widest <= WIDTHS[s]
        if not fits.any():
            break
        choice[:, : block - run + 1] -= fits.view(np.int8)
    # Words of all blocks side by side; a block that is through stays at the place after the last.
    none = blocks * block
    after = np.arange(none + 1)
    after[:-1] += COUNTS[choice.reshape(-1)]
    tight = after[:-1].reshape(blocks, block)
    tight[tight >= np.minimum((np.arange(blocks) + 1) * block, n)[:, None]] = none
    at, steps = np.arange(blocks) * block, []
    while len(steps) % 64 or (at < none).any():
        steps.append(at)
        at = after[at]
    start = np.stack(steps, axis=1).reshape(-1)
    start = start[start < none]
    choice, owner = choice.reshape(-1), start // block
    selector = choice[start].astype(np.int64)
    word = selector.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        mine = np.flatnonzero(selector == s)
        first, packed = start[mine], word[mine]
        for k in range(COUNTS[s] if len(mine) else 0):
            value = ids[first + k]
            if s == 15:
                value = np.minimum(value, ESCAPE)
            packed |= value << np.uint64(k * WIDTHS[s])
        word[mine] = packed
    escaped = (selector == 15) & (ids[start] >= ESCAPE)
    size = 1 + escaped.astype(np.int64)
    where = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    out[where] = word
    out[where[escaped] + 1] = ids[start[escaped]]
    return out, np.concatenate([[0], np.cumsum(np.bincount(owner, weights=size, minlength=blocks))]).astype(np.int64)


def decode_blocks(words: np.ndarray) -> np.ndarray:
    """Ids of whole blocks' words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    marks = np.flatnonzero((words & _PAYLOAD == ESCAPE) & (selector == 15))
    raw = np.zeros(len(words), bool)
    for m in marks:  # only ids of 60 bits and more have escapes; a raw word may look like one
        if not raw[m]:
            raw[m + 1] = True
    head = np.flatnonzero(~raw)
    counts = COUNTS[selector[head]]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(selector[head] == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[first[mine] + k] = (words[head[mine]] >> np.uint64(k * WIDTHS[s])) & mask
    escaped = np.flatnonzero(np.append(raw, False)[head + 1])
    out[first[escaped]] = words[head[escaped] + 1]
    return out


def file_image(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Bytes of a file of documents."""
    words, offsets = encode_blocks(ids)
    null = np.array([k is None for k in keys], np.uint8)
    body = b"".join(
        [
            np.array([0 if k is None else k for k in keys], "<i8").tobytes(),
            null.tobytes(),
            np.asarray(lengths).astype("<u8").tobytes(),
            offsets.astype("<u8").tobytes(),
            words.astype("<u8").tobytes(),
        ]
    )
    return MAGIC + struct.pack("<QQQI", len(keys), len(offsets) - 1, len(words), zlib.crc32(body)) + body


def _parts(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray]:
    """Keys, lengths, block offsets and words of a file; a damaged one raises."""
    head = struct.calcsize("<QQQI")
    docs, blocks, n_words, check = struct.unpack("<QQQI", data[4 : 4 + head])
    body = data[4 + head :]
    if data[:4] != MAGIC or zlib.crc32(body) != check:
        raise ValueError("damaged token file")
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, n, at)
        at += out.nbytes
        return out

    keys, null, lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
    offsets, words = take("<u8", blocks + 1), take("<u8", n_words)
    return [None if m else int(k) for k, m in zip(keys, null)], lengths.astype(np.int64), offsets.astype(np.int64), words.astype(np.uint64)


def read_image(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, lengths and ids of a file."""
    keys, lengths, _, words = _parts(data)
    return keys, lengths, decode_blocks(words)


def read_documents(data: bytes, first: int, stop: int) -> list[np.ndarray]:
    """Ids of the documents from place ``first`` to before ``stop``; only their blocks are decoded."""
    _, lengths, offsets, words = _parts(data)
    bounds = np.concatenate([[0], np.cumsum(lengths)])[first : stop + 1]
    if len(bounds) < 2:
        return []
    block, last = int(bounds[0]) // BLOCK, -(-int(bounds[-1]) // BLOCK)
    ids = decode_blocks(words[offsets[block] : offsets[max(last, block)]])
    return [ids[a:b] for a, b in zip(bounds - block * BLOCK, (bounds - block * BLOCK)[1:])]


# -- jobs --------------------------------------------------------------------

# Texts with these are encoded whole: four control characters and white space beyond ASCII.
_WHOLE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# The character that a byte-level vocabulary writes for each byte: itself if it is seen, else one from 256 on.
_SEEN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = np.zeros(256, "<u2")
_SPELLED[_SEEN_BYTES] = _SEEN_BYTES
_SPELLED[_SPELLED == 0] = np.arange(256, 512 - len(_SEEN_BYTES))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Slots that lead to known pieces; a power of two.
SLOTS = 1 << 22
_SLOT = np.uint64(SLOTS - 1)


def id_kind(definition: str) -> str:
    """The narrowest of two integer kinds that holds every id of the vocabulary."""
    spec = json.loads(definition)
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), END_ID])
    return "<u2" if top < 1 << 16 else "<u4"


def token_bytes(definition: str) -> np.ndarray:
    """Bytes of text each id stands for; a byte-level vocabulary spells one character a byte."""
    spec = json.loads(definition)
    size = {i: len(t) for t, i in spec["model"]["vocab"].items()}
    size |= {t["id"]: len(t["content"].encode()) for t in spec["added_tokens"]}
    return np.array([size.get(i, 0) for i in range(max(size) + 1)], np.int64)


def _tail(byte: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether a byte ends a letter from U+00C0 to U+00FF; all but two of these characters are letters."""
    return (before == 0xC3) & (byte != 0x97) & (byte != 0xB7)


def _opens(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places in UTF-8 texts, laid end to end, where the byte-level pattern cannot but begin anew.

    White space before a word is apart from it but for one blank, and its last
    character from the rest. A single stop or comma between a letter and white
    space is apart too.
    """
    n = len(data)
    space = (data == _BLANK) | (data - np.uint8(9) < 5)
    begin = np.zeros(n + 1, bool)
    begin[begins] = begin[n] = True
    opens = begin[:n].copy()
    turn = space[1:] != space[:-1]
    opens[1:] |= turn & space[1:]
    leaves = turn & space[:-1] & ~begin[1:n]
    opens[:-1] |= leaves
    opens[1:] |= leaves & (data[:-1] != _BLANK)
    ends = begin[1:]
    ends[:-1] |= space[1:]
    dot = np.flatnonzero(((data == 46) | (data == 44)) & ends & ~opens)
    before = data[dot - 1]
    opens[dot[_LETTER[before] | _tail(before, data[np.maximum(dot - 2, 0)])]] = True
    return np.flatnonzero(opens)


class PieceEncoder:
    """A library tokenizer asked once per piece of text that it treats on its own.

    A piece of letters alone, after at most one blank, is one match of the
    byte-level pattern: it is handed to the library's merges as that vocabulary
    spells it. All other pieces go the library's whole way.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        spec = json.loads(definition)
        self.apart = [*_WHOLE, *(t["content"] for t in spec["added_tokens"])]
        self.widths = token_bytes(definition)
        self.kind = id_kind(definition)

    def stays_whole(self, text: str) -> bool:
        return any(x in text for x in self.apart)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _joint(self, tokenizer: Tokenizer, text: str, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that go through one call; the bytes the tokens stand for tell how many are whose."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        cut = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(size), "right")
        return ids, np.diff(cut, prepend=0)

    def words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Whether each piece of ``data`` is letters after at most one blank; ids and their numbers for those that are."""
        ends = np.cumsum(size)
        taken = data[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]))]
        letter = _LETTER[taken]
        tail = np.flatnonzero(_tail(taken[1:], taken[:-1])) + 1
        letter[tail] = letter[tail - 1] = True
        blank = taken[ends - size] == _BLANK
        is_word = (np.add.reduceat(letter, ends - size, dtype=np.int64) + blank == size) & (size > blank)
        spelled, size = _SPELLED[taken[np.repeat(is_word, size)]], size[is_word]
        ids, counts = [], []
        ends = np.concatenate([[0], np.cumsum(size)])
        for k in range(0, len(size), JOINT):
            part = size[k : k + JOINT]
            letters = spelled[ends[k] : ends[k + len(part)]]
            text = np.insert(letters, np.cumsum(part)[:-1], _BLANK).tobytes().decode("utf-16-le")
            found, count = self._joint(self.merges, text, part)
            ids.append(found)
            counts.append(count)
        return is_word, ids, counts

    def pieces(self, asked: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and their numbers for distinct pieces, in order of ``asked``."""
        # Pieces that start with white space and end with a word stay apart when they follow each other,
        # so many go through one call.
        follows = [p[0].isspace() and not p[-1].isspace() for p in asked]
        joint = [p for p, f in zip(asked, follows) if f]
        found: list[np.ndarray] = []
        for k in range(0, len(joint), JOINT):
            part = joint[k : k + JOINT]
            ids, count = self._joint(self.tokenizer, "".join(part), np.array([len(p.encode()) for p in part]))
            found += np.split(ids, np.cumsum(count)[:-1])
        alone = self.tokenizer.encode_batch([p for p, f in zip(asked, follows) if not f], add_special_tokens=False)
        first, second = iter(found), iter(alone)
        ids = [next(first) if f else np.array(next(second).ids, self.kind) for f in follows]
        return ids, [np.array([len(x) for x in ids], np.int64)]


def _marks(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    return flatwords.mix(first ^ flatwords.mix(second + size.astype(np.uint64)))


class FlatEncoder:
    """Encodes many texts at once: pieces are marked in one flat array of bytes and found in a table of known pieces.

    A piece of up to 16 bytes is two 64-bit numbers and a length, so it is
    compared exactly and no Python object is made for it; a longer one is looked
    up by its bytes. Two slots tell where a piece is in the table; one that was
    pushed out of both is asked for again. Texts with separators that Python
    and the library class differently, with white space beyond ASCII, or with
    an added token are encoded whole.
    """

    def __init__(self, definition: str):
        self.library = PieceEncoder(definition)
        self.kind = self.library.kind
        self.turn = 0
        self._clear()

    def _clear(self) -> None:
        self.slots = [np.full(SLOTS, -1, np.int32) for _ in range(2)]
        self.long: dict[bytes, int] = {}
        self.first, self.second = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.size, self.at, self.count = np.zeros(1, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int32)
        self.last = np.zeros(1, np.int32)
        self.pool = np.zeros(0, self.kind)
        self.entries, self.ids = 1, 0

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Writes values into a column from a place on; a column without room is doubled."""
        column = getattr(self, name)
        if at + len(values) > len(column):
            column = np.concatenate([column[:at], np.zeros(at + 2 * len(values), column.dtype)])
            setattr(self, name, column)
        column[at : at + len(values)] = values

    def _known(self, first: np.ndarray, second: np.ndarray, size: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Place of each piece in the table, -1 if it is in neither slot."""
        entry = self.slots[0][mark & _SLOT]
        for slot in (1, None):
            wrong = (entry < 0) | (self.first[entry] != first) | (self.second[entry] != second) | (self.size[entry] != size)
            entry[wrong] = -1 if slot is None else self.slots[slot][(mark[wrong] >> np.uint64(32)) & _SLOT]
        return entry.astype(np.int64)

    def _add(self, first: np.ndarray, second: np.ndarray, size: np.ndarray, mark: np.ndarray, ids: list[np.ndarray], count: np.ndarray) -> np.ndarray:
        """New entries; pieces of more than 16 bytes come with no mark in ``mark`` and after the others."""
        begin, found = self.entries, np.concatenate(ids)
        self._put("at", begin, self.ids + np.cumsum(count) - count)
        self._put("pool", self.ids, found)
        self._put("first", begin, first)
        self._put("second", begin, second)
        self._put("size", begin, np.minimum(size, 255))  # of a long piece no more is asked than that it is long
        self._put("count", begin, count)
        self._put("last", begin, np.full(len(count), self.turn))
        self.entries, self.ids = begin + len(count), self.ids + len(found)
        entry = np.arange(begin, self.entries, dtype=np.int32)
        short = entry[: len(mark)]
        place = (mark & _SLOT).astype(np.int64)
        free = self.slots[0][place] < 0
        self.slots[0][place[free]] = short[free]
        lost = self.slots[0][place] != short
        self.slots[1][((mark[lost] >> np.uint64(32)) & _SLOT).astype(np.int64)] = short[lost]
        return entry.astype(np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        flat = [b"" if self.library.stays_whole(t) else t.encode("utf-8") for t in texts]
        sizes = np.array([len(x) for x in flat], np.int64)
        stops = np.cumsum(sizes)
        joined = b"".join(flat) + bytes(16)
        data = np.frombuffer(joined, np.uint8)
        n = len(data) - 16
        if not n:
            return [self.library.whole(t) if t else b"" for t in texts]
        start = _opens(data[:n], (stops - sizes)[sizes > 0])
        size = np.diff(np.append(start, n))
        short = np.flatnonzero(size <= 16)
        window = np.ndarray((n + 9,), "<u8", joined, 0, (1,))  # the eight bytes from every place on
        at, length = start[short], size[short]
        first = window[at] & _MASKS[np.minimum(length, 8)]
        second = window[at + 8] & _MASKS[np.maximum(length - 8, 0)]
        mark = _marks(first, second, length)
        entry = np.empty(len(start), np.int64)
        entry[short] = self._known(first, second, length, mark)
        fresh = short[entry[short] < 0]
        where = np.flatnonzero(entry[short] < 0)
        # Pieces not known, once each; if two of one mark differ, by all that makes them what they are.
        shape = np.stack([first[where], second[where], length[where].astype(np.uint64)], axis=1)
        _, one, back = np.unique(mark[where], return_index=True, return_inverse=True)
        if (shape[one][back] != shape).any():
            _, one, back = np.unique(shape, axis=0, return_index=True, return_inverse=True)
        chosen = where[one]
        long_at = np.flatnonzero(size > 16)
        keys = [joined[x : x + k] for x, k in zip(start[long_at].tolist(), size[long_at].tolist())]
        new_long = list({k for k in keys if k not in self.long})
        ids, counts = [], []
        if len(chosen):
            is_word, ids, counts = self.library.words(data, at[chosen], length[chosen])
            words_first = np.argsort(~is_word, kind="stable")
            chosen = chosen[words_first]
            others = chosen[int(is_word.sum()) :]
        if len(chosen) or new_long:
            asked = [joined[x : x + k] for x, k in zip(at[others].tolist(), length[others].tolist())] if len(chosen) else []
            more, number = self.library.pieces([k.decode() for k in [*asked, *new_long]])
            pad = np.zeros(len(new_long), np.uint64)
            added = self._add(
                np.concatenate([first[chosen], pad]), np.concatenate([second[chosen], pad]),
                np.concatenate([length[chosen], np.array([len(k) for k in new_long], np.int64)]), mark[chosen],
                [*ids, *more], np.concatenate([*counts, *number]),
            )
            if len(chosen):
                place = np.empty(len(chosen), np.int64)
                place[words_first] = added[: len(chosen)]
                entry[fresh] = place[back.reshape(-1)]
            self.long.update(zip(new_long, added[len(chosen) :].tolist()))
        entry[long_at] = [self.long[k] for k in keys]
        self.last[entry] = self.turn = self.turn + 1
        count = self.count[entry]
        ends = np.cumsum(count, dtype=np.int64)
        place = np.repeat(self.at[entry] - ends + count, count) + np.arange(int(ends[-1]))
        ids = self.pool[place].tobytes()
        cuts = np.concatenate([[0], ends])[np.searchsorted(start, np.concatenate([[0], stops]))] * self.pool.itemsize
        out = [ids[x:y] for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
        if self.entries > SEEN:
            self._keep()
        return [self.library.whole(t) if not f and t else o for t, f, o in zip(texts, flat, out)]

    def _keep(self) -> None:
        """Only the entries used last stay, so that common pieces outlive the rest."""
        used = np.argsort(self.last[1 : self.entries], kind="stable")[-(SEEN // 2) :] + 1
        long = self.size[used] > 16
        used = np.concatenate([used[~long], used[long]])
        short = used[: len(used) - int(long.sum())]
        first, second, size, count, last = (x[used] for x in (self.first, self.second, self.size, self.count, self.last))
        ends = np.cumsum(count, dtype=np.int64)
        ids = self.pool[np.repeat(self.at[used] - ends + count, count) + np.arange(int(ends[-1]))]
        names = {e: k for k, e in self.long.items()}
        self._clear()
        mark = _marks(first[: len(short)], second[: len(short)], size[: len(short)])
        added = self._add(first, second, size, mark, [ids], count)
        self._put("last", 1, last)
        self.long = {names[e]: k for e, k in zip(used[len(short) :].tolist(), added[len(short) :].tolist())}


def _encoded(docs: DataFrame, definition: str, key: str, text: str) -> DataFrame:
    """(key, ids): ids of each text with the end id, packed as ``id_kind`` says."""

    # A worker process holds the value of a broadcast for its next tasks, and with it the encoder that a task puts
    # there. What the package itself holds starts anew with each task, since its code travels with the task.
    shared = docs.sparkSession.sparkContext.broadcast({"definition": definition})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        encoder = held.get("encoder") or held.setdefault("encoder", FlatEncoder(held["definition"]))
        end = np.array([END_ID], encoder.kind).tobytes()
        for batch in batches:
            keys, texts = batch["key"].astype("Int64"), batch["text"].fillna("").tolist()
            begin, total = 0, 0
            cuts = []
            for k, t in enumerate(texts):
                if k > begin and total + len(t) > CHARACTERS:
                    cuts.append((begin, k))
                    begin, total = k, 0
                total += len(t)
            for a, b in [*cuts, (begin, len(texts))]:
                ended = [i + end for i in encoder.encode(texts[a:b])]
                yield pd.DataFrame({"key": keys.iloc[a:b].to_numpy(object, na_value=None), "ids": ended})

    pairs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return pairs.mapInPandas(encode, "key long, ids binary")


def write_files(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The files as a stored table (range, file, n_ids, image), in the order of the keys by range and file."""
    with open(vocabulary, encoding="utf-8") as f:
        definition = f.read()
    spark = docs.sparkSession
    rows = docs.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(docs.agg(F.percentile_approx(F.col(key).cast("long"), shares or [0.5], 20 * ranges)).first()[0] or []))

    kind = id_kind(definition)
    wide = np.dtype(kind).itemsize

    def image(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = {}, []

        def flush(part: int) -> pd.DataFrame:
            ids = [np.frombuffer(x, kind) for _, x in held]
            keys = [None if pd.isna(k) else int(k) for k, _ in held]
            data = file_image(keys, np.array([len(i) for i in ids]), np.concatenate(ids))
            held.clear()
            number[part] = number.get(part, -1) + 1
            return pd.DataFrame({"range": [part], "file": [number[part]], "n_ids": [sum(map(len, ids))], "image": [data]})

        current, size = None, 0
        for batch in batches:
            for part, k, x in zip(batch["range"].tolist(), batch["key"].astype("Int64"), batch["ids"]):
                if held and (part != current or size + len(x) // wide > FILE_IDS):
                    yield flush(current)
                    size = 0
                current = part
                held.append((k, x))
                size += len(x) // wide
        if held:
            yield flush(current)

    encoded = _encoded(docs, definition, key, text)
    below = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>")
    # How many cuts lie below the key; the cuts are sorted and distinct.
    part = F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.size(F.filter(below, lambda c: c < F.col("key"))))
    laid = encoded.withColumn("range", part.cast("int")).repartitionById(len(cuts) + 1, "range")
    files = laid.sortWithinPartitions("range", "key", "ids").mapInPandas(image, "range int, file int, n_ids long, image binary")
    return materialize(files, "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files."""
    sizes = files.select("range", "file", "n_ids")
    per_range = sizes.groupBy("range").agg(F.sum("n_ids").alias("n"))
    # One row per range of keys: their number does not grow with the length of the documents.
    before = per_range.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("base"))
    inside = sizes.select(
        "range", "file", (F.sum("n_ids").over(W.partitionBy("range").orderBy("file")) - F.col("n_ids")).alias("within")
    )
    offsets = inside.join(before, "range").select("range", "file", (F.col("within") + F.col("base")).alias("offset"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, file, data in zip(batch["range"], batch["file"], batch["image"]):
                keys, lengths, ids = read_image(data)
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                flat = ids.astype("<u4").tobytes()
                yield pd.DataFrame(
                    {
                        "range": part,
                        "file": file,
                        "key": pd.array(keys, dtype="Int64").to_numpy(object, na_value=None),
                        "at": bounds[:-1],
                        "n_tokens": lengths,
                        "ids_crc32": [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])],
                    }
                )

    schema = "range int, file int, key long, at long, n_tokens long, ids_crc32 long"
    found = files.select("range", "file", "image").mapInPandas(read, schema)
    return found.join(offsets, ["range", "file"]).select(
        "key", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files and reads them: one row (key, start, n_tokens, ids_crc32) per input row."""
    return read_files(write_files(docs, vocabulary, key, text)).withColumnRenamed("key", key)
