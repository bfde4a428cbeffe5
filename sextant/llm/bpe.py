"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array.  A round looks every adjacent
pair up in the sorted keys of the merge table by binary search, takes the
lowest rank of each word, and joins all its places at once.  A merge never
creates a pair of lower rank than its own, so a round does what repeated
single merges would do.

Beyond Latin letters the library that defines the vocabulary normalises and cuts
the text into words; encoding them is done here.

Only words not seen before in a task go through the rounds; a table of seen
words, bounded by SEEN, answers the rest.  The vocabulary file has a fixed size
and travels with the task.  Rows stay where they are: no shuffle.

Defined cases: null and empty text give no id and decode to the empty string;
repeated rows are encoded alike and all returned; an empty table gives an empty
result; only the key and the text are read, so other columns cannot clash.  A
byte symbol without an id is left out, as the vocabulary's model does.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

SEEN = 400_000
#: Characters taken up at a time, whatever the size of an Arrow batch; a longer text is taken alone.
CHARACTERS = 2_000_000
NO_RANK = np.iinfo(np.int64).max

# White space of the Unicode property; Python's own split also breaks at four control characters.
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = regex.compile("[\x1c-\x1f]")
#: Beyond these the Unicode tables of Python and of the vocabulary's library may be of different versions.
_BEYOND_LATIN = regex.compile("[^\x00-\u024f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a vocabulary whose words end in a suffix; made from the file's JSON text."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError("the vocabulary is not a lower-case BPE with word ends")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.suffix = model["end_of_word_suffix"]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        reader = Tokenizer.from_str(definition)
        self.wide_normalizer = reader.normalizer
        self.wide_split = pre_tokenizers.Split(Regex(self.words.pattern), "removed", invert=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        get = self.vocab.get
        symbols = byte_symbols()
        self.inner = np.array([get(s, -1) for s in symbols], np.int64)
        self.last = np.array([get(s + self.suffix, -1) for s in symbols], np.int64)
        left = np.array([get(a, -1) for a, _ in model["merges"]], np.int64)
        right = np.array([get(b, -1) for _, b in model["merges"]], np.int64)
        self.joined = np.array([get(a + b, -1) for a, b in model["merges"]], np.int64)
        self.width = max(self.vocab.values()) + 2
        keys = left * self.width + right
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]
        self.seen: dict[str, tuple[int, ...]] = {}

    # -- words ------------------------------------------------------------

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word by merge rounds over all of them at once."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words)), sizes)
        symbol = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        symbol[ends] = self.last[flat[ends]]
        known = symbol >= 0
        symbol, owner = symbol[known], owner[known]
        done_symbols, done_owners = [], []
        while len(symbol) > 1:
            rank = self._ranks_of(symbol, owner)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(owner)])
            per_symbol = np.repeat(lowest, counts)
            finished = per_symbol == NO_RANK
            if finished.any():
                done_symbols.append(symbol[finished])
                done_owners.append(owner[finished])
                open_ = ~finished
                symbol, owner, rank, per_symbol = symbol[open_], owner[open_], rank[open_], per_symbol[open_]
                if not len(symbol):
                    break
            merge = _first_of_overlaps((rank == per_symbol) & (rank != NO_RANK))
            symbol[merge] = self.joined[rank[merge]]
            keep = np.r_[True, ~merge[:-1]]
            symbol, owner = symbol[keep], owner[keep]
        symbol = np.concatenate([*done_symbols, symbol])
        owner = np.concatenate([*done_owners, owner])
        order = np.argsort(owner, kind="stable")
        per_word = np.bincount(owner, minlength=len(words))
        ids = symbol[order].tolist()
        bounds = np.concatenate([[0], np.cumsum(per_word)]).tolist()
        return [tuple(ids[a:b]) for a, b in zip(bounds, bounds[1:])]

    def _ranks_of(self, symbol: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Merge rank of each symbol with its right neighbour in the word; NO_RANK where there is none."""
        rank = np.full(len(symbol), NO_RANK, np.int64)
        if not len(self.keys):
            return rank
        key = symbol[:-1] * self.width + symbol[1:]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[place] == key) & (owner[:-1] == owner[1:])
        rank[:-1][hit] = self.ranks[place[hit]]
        return rank

    # -- texts ------------------------------------------------------------

    def normalized(self, text: str) -> str:
        """Composed, in lower case."""
        if _BEYOND_LATIN.search(text):
            return self.wide_normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).lower()

    def _split(self, piece: str) -> list[str]:
        if _BEYOND_LATIN.search(piece):
            return [w for w, _ in self.wide_split.pre_tokenize_str(piece)]
        return self.words.findall(piece)

    def chunks(self, text: str) -> list[str]:
        """Pieces between white space, which no word crosses; special tokens of the raw text stay whole, after a blank."""
        parts = [text] if self.cut is None or "<" not in text else self.cut.split(text)
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(" " + part)
                continue
            part = self.normalized(part)
            out += [x for x in _SPACE.split(part) if x] if _ODD.search(part) else part.split()
        return out

    def encode(self, texts: Iterable[str]) -> list[list[int]]:
        """Ids of each text."""
        pieces = [self.chunks(t) for t in texts]
        self._learn(pieces)
        seen = self.seen
        return [[i for p in one for i in seen[p]] for one in pieces]

    def _learn(self, pieces: list[list[str]]) -> None:
        if len(self.seen) > SEEN:
            self.seen.clear()
        fresh = {p for one in pieces for p in one if p not in self.seen}
        marked = {p for p in fresh if p[0] == " "}
        for p in marked:
            self.seen[p] = (self.special[p[1:]],)
        fresh -= marked
        split = {p: self._split(p) for p in fresh}
        words = list({w for ws in split.values() for w in ws})
        ids = dict(zip(words, self.encode_words([w.encode() for w in words]))) if words else {}
        for p, ws in split.items():
            self.seen[p] = ids[ws[0]] if len(ws) == 1 else tuple(i for w in ws for i in ids[w])

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, special ones included; ids outside the vocabulary are left out."""
        get = self.tokens.get
        return " ".join([t for t in map(get, ids) if t is not None])


def _first_of_overlaps(merge: np.ndarray) -> np.ndarray:
    """Of each run of marked places only every second one, from the left: places next to each other overlap."""
    if not (merge[1:] & merge[:-1]).any():
        return merge
    at = np.arange(len(merge))
    begin = np.maximum.accumulate(np.where(merge & ~np.r_[False, merge[:-1]], at, 0))
    return merge & ((at - begin) % 2 == 0)


def in_portions(texts: pd.Series, characters: int = CHARACTERS) -> Iterator[tuple[int, int]]:
    """Bounds of stretches with at most so many characters, or one text."""
    begin, total = 0, 0
    for k, size in enumerate(texts.str.len()):
        if k > begin and total + size > characters:
            yield begin, k
            begin, total = k, 0
        total += size
    if begin < len(texts):
        yield begin, len(texts)


def token_digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_tokens, ids_sha256 and decoded_sha256 of the ids as they decode.

    ``vocabulary`` is the path of a vocabulary file on the driver.
    """
    with open(vocabulary, encoding="utf-8") as f:
        definition = f.read()
    pairs = docs.select(key, text)
    schema = T.StructType(
        [
            pairs.schema[key],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    names = [f.name for f in schema]

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = WordBpe(definition)
        digits = [str(i) for i in range(max(bpe.tokens) + 1)]

        def sha(s: str) -> str:
            return hashlib.sha256(s.encode()).hexdigest()

        for batch in batches:
            texts = batch.iloc[:, 1].fillna("")
            for a, b in in_portions(texts):
                ids = bpe.encode(texts.iloc[a:b])
                yield pd.DataFrame(
                    {
                        names[0]: batch.iloc[a:b, 0].to_numpy(),
                        "n_tokens": [len(x) for x in ids],
                        "ids_sha256": [sha(" ".join([digits[i] for i in x])) for x in ids],
                        "decoded_sha256": [sha(bpe.decode(x)) for x in ids],
                    }
                )

    return pairs.mapInPandas(digests, schema)
