"""Token ids of whole texts by a public tokenizer file, with each distinct word encoded once per worker.

The tokenizer (BPE inside words, lower-cased, white space dropped) never joins what white
space parts, so the ids of a text are those of its blank-separated runs in turn, and the
ids of a run those of its words.  Texts of plain Latin letters are cut into runs here, the
distinct runs of a batch into words, and only distinct words are looked up or encoded; any
text with other characters, or with the mark of a special token, goes to the tokenizer as a whole.
A tokenizer file of another kind is noticed and gets every text as a whole.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from sievework.llm.bytesets import Texts

#: How the tokenizer cuts a text into words.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters beyond these may be composed, lower-cased or cut by other rules.
_OTHER = "[^\\t-\\r -~¡-įı-ňŊ-ſ]|<[|]"
_MOST_WORDS = 400_000
_LETTER, _DIGIT = 1, 2
#: Kind of each of those characters: letter, digit or anything else.
_KIND = np.array([_LETTER if regex.match(r"\p{L}", chr(c)) else _DIGIT if regex.match(r"\p{N}", chr(c)) else 0 for c in range(0x180)], np.uint8)
#: What an apostrophe takes with it, by length, as numbers.
_ENDINGS = {1: list(b"stmd"), 2: [a << 8 | b for a, b in (b"re", b"ve", b"ll")]}


def cuts_at_blanks(tokenizer) -> bool:
    """Whether the tokenizer lower-cases, drops white space and marks word ends, as the shared words ask for."""
    told = json.loads(tokenizer.to_str())
    normalizer, cutter = told["normalizer"] or {}, told["pre_tokenizer"] or {}
    steps = [step["type"] for step in normalizer.get("normalizers", [])]
    first = next(iter(cutter.get("pretokenizers", [])), {})
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and first.get("pattern") == {"Regex": _WORDS.pattern}
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and told["model"].get("end_of_word_suffix") == "</w>"
        and all(token["content"].startswith("<|") for token in told["added_tokens"])
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def word_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the words begin in the bytes of lower-cased runs of plain characters; ``bounds`` are the runs' ends after a zero."""
    kind = _KIND[data & 0x7F]
    lead = np.flatnonzero(data >= 0xC0)  # plain characters have two bytes at most
    kind[lead] = kind[lead + 1] = _KIND[(data[lead] & 0x1F).astype(np.int64) << 6 | data[lead + 1] & 0x3F]
    first = kind == _DIGIT  # a word each
    first[lead + 1] = False
    first[1:] |= kind[1:] != kind[:-1]
    first[bounds[bounds < len(data)]] = True
    # An apostrophe that begins a word takes some endings with it, and what follows them begins another word.
    mark = np.flatnonzero((data == ord("'")) & first)
    ahead = np.append(data, np.zeros(2, np.uint8)).astype(np.int64)
    end = bounds[np.searchsorted(bounds, mark, "right")]
    one, two = ahead[mark + 1], ahead[mark + 1] << 8 | ahead[mark + 2]
    size = np.where(np.isin(two, _ENDINGS[2]) & (mark + 3 <= end), 3, np.where(np.isin(one, _ENDINGS[1]) & (mark + 2 <= end), 2, 0))
    mark, size = mark[size > 0], size[size > 0]
    first[mark + 1] = False
    first[(mark + size)[mark + size < len(data)]] = True
    return np.flatnonzero(first)


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given ranges of ``pool`` one after the other, and where each of them ends there, after a zero."""
    upto = np.concatenate([[0], np.cumsum(size)])
    return pool[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])], upto


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = cuts_at_blanks(self.tokenizer)
        # Words that are cut and lower-cased already need neither step again.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = None
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        #: Number of each known word; its ids are ``size`` ones from ``start`` of the pool, ``met`` is the last batch that had it.
        self.words: dict[str, int] = {}
        self.pool = np.zeros(0, "<u4")
        self.start, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.batch = 0
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Ids of distinct words that are not known yet."""
        pools, sizes = [self.pool], [self.size]
        for i in range(0, len(words), 512):
            part = words[i : i + 512]
            ids = np.array(self.of_words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):  # a word without an end mark: one by one
                own = [np.frombuffer(self.whole(w), "<u4") for w in part]
                ids, cuts = np.concatenate(own), np.cumsum([len(x) for x in own])
            pools.append(ids)
            sizes.append(np.diff(cuts, prepend=0))
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.pool, self.size = np.concatenate(pools), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size
        self.met = np.append(self.met, np.full(len(words), self.batch))

    def _forget(self) -> None:
        """Keep the half of the words that was met last."""
        kept = np.sort(np.argsort(-self.met, kind="stable")[: _MOST_WORDS // 2])
        names = list(self.words)
        self.words = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.pool, upto = gather(self.pool, self.start[kept], self.size[kept])
        self.start, self.size, self.met = upto[:-1], self.size[kept], self.met[kept]

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The number of each of these distinct words; unknown ones are learned."""
        self.batch += 1
        if len(self.words) > _MOST_WORDS:
            self._forget()
        found = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = np.arange(len(self.words), len(self.words) + len(new))
            self._learn([words[i] for i in new.tolist()])
        self.met[found] = self.batch
        return found

    def _ids_of_runs(self, runs: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct runs one after the other, and where each run ends there, after a zero."""
        texts = Texts(runs)
        bounds = texts.bounds
        starts = word_starts(texts.data, bounds)
        offsets = pa.py_buffer(np.append(starts, len(texts.data)))
        coded = pa.LargeStringArray.from_buffers(len(starts), offsets, pa.py_buffer(texts.data)).dictionary_encode()
        number = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        ids, upto = gather(self.pool, self.start[number], self.size[number])
        return ids, upto[np.searchsorted(starts, bounds)]

    def ids_of(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a missing text has none.  Meant for batches of a few megabytes."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.by_words:
            return [np.frombuffer(self.whole(text.as_py()), "<u4") for text in texts]
        plain = ~(pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False))
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        for i in np.flatnonzero(~plain):
            out[i] = np.frombuffer(self.whole(texts[int(i)].as_py()), "<u4")
        rows = np.flatnonzero(plain)
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.take(pa.array(rows))))
        coded = lists.flatten().dictionary_encode()
        pool, bounds = self._ids_of_runs(coded.dictionary)
        code = coded.indices.to_numpy()
        ids, upto = gather(pool, bounds[:-1][code], np.diff(bounds)[code])
        offsets = lists.offsets.to_numpy()
        cut = upto[offsets - offsets[0]]
        for row, low, high in zip(rows.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
            out[row] = ids[low:high]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
