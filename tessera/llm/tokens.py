"""Fast, exact encoders for the public tokenizer files of the `tokenizers` library.

The library is the definition; these only avoid its per-word cost.  Each encoder is compared with
the library on a set of sample strings when it is first loaded in a process, and falls back to it on
any difference, and for texts outside what its shortcut covers.  Where the shortcut depends on properties
of characters (letter, number, lower case), each character beyond ASCII is compared with the library in all
contexts that matter when it is first met; words with one that differs are the library's.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex

SAMPLES = (
    "", " ", "Hello, world!", "it's  they'll\n\n we've 'stop  3rd 2048 x2\t y", "Äöü ñandú ciónrr, élève œuvre ßtraße", "a b   c​",
    "日本語テキスト 한국어 🙂🙂‍↔️ é ﬁ", "### $$$ &&& <|x|> <p>q</p> !!!", "UPPER Case İstanbul ΟΔΟΣ", "x" * 300, "a  b   c\n\n\nd \n e", "\x1c\x85 q\x00r",
)


#: Characters that one numpy pass works on.
PASS = 1 << 21
SPACE, LETTER, NUMBER, OTHER, AWAY, UNKNOWN = range(6)
# The endings that the tokenizer's pattern cuts off behind an apostrophe.
ONE, TWO = [ord(c) for c in "stmd"], [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]

# Ranges of Hangul letters that join with what stands beside them.
JAMO = (("\u1100", "\u11ff"), ("\ua960", "\ua97f"), ("\ud7b0", "\ud7ff"))


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """ids(text) -> numpy uint32 ids of a text, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.joined = None  # a method for many texts in one pass, where there is one
        self.fast = self._fast(path)
        if self.fast and any(not np.array_equal(self.fast(x), self.slow(x)) for x in SAMPLES):
            self.fast = self.joined = None
        if self.joined and not np.array_equal(self.many(SAMPLES)[0], np.concatenate([self.slow(x) for x in SAMPLES])):
            self.joined = None

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        return self.fast(text) if self.fast and not self.special.search(text) else self.slow(text)

    def many(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each text has."""
        if not self.joined:
            ids = [self.ids(x) for x in texts]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)
        texts = [x or "" for x in texts]
        one_by_one = {i for i, x in enumerate(texts) if self.special.search(x)} if self.special.search("\n".join(texts)) else set()
        one_by_one |= self.uncovered(texts)
        ids, counts = self.joined(["" if i in one_by_one else x for i, x in enumerate(texts)] if one_by_one else texts)
        if not one_by_one:
            return ids, counts
        parts, done, ends = [], 0, np.cumsum(counts)
        for i in sorted(one_by_one):
            own = self.ids(texts[i])
            parts += [ids[done : ends[i]], own]
            done, counts[i] = ends[i], len(own)
        return np.concatenate([*parts, ids[done:]]), counts

    def _fast(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        added = [x["content"] for x in data.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        pre, model = data.get("pre_tokenizer") or {}, data["model"]
        if model.get("type") != "BPE" or model.get("dropout") or model.get("unk_token") in model["vocab"] and model.get("byte_fallback"):
            return None
        letters = byte_letters()
        vocab = {k: v for k, v in model["vocab"].items() if k not in added}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not data.get("normalizer") and not model.get("end_of_word_suffix"):
            return self._whole_text({bytes(letters[c] for c in k): v for k, v in vocab.items()})
        if model.get("end_of_word_suffix") == "</w>" and (data.get("normalizer") or {}).get("type") == "Sequence":
            return self._by_word(vocab, letters)
        return None

    def _whole_text(self, ranks: dict[bytes, int]):
        """Byte-level BPE whose ids are its merge order: tiktoken runs it over whole texts."""
        import tiktoken

        # Fixed value: the splitting pattern of the byte-level pre-tokenizer.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def _by_word(self, vocab: dict[str, int], letters: dict[str, int]):
        """BPE with word ends that drops white space: ids of a text are those of its units between spaces.

        A bounded cache keeps the ids of units.  A miss of trusted characters is split as the library splits it, and each
        word, with a space for its end (no word holds one), goes to tiktoken, as ids are the order of merges; any other
        miss goes to the library.  Many texts are cut into words in one pass instead, without a cache.
        """
        import tiktoken

        end = b" "
        ranks = {bytes(letters[c] for c in k.removesuffix("</w>")) + end * k.endswith("</w>"): v for k, v in vocab.items()}
        encoding = tiktoken.Encoding("own", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        piece = encoding._core_bpe.encode_single_piece
        closes = np.zeros(max(ranks.values()) + 1, bool)
        closes[[v for k, v in vocab.items() if k.endswith("</w>")]] = True
        # Fixed value: the splitting pattern of the tokenizer.
        words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        slow, most = self.slow, 250_000

        def shortcut(unit: str) -> bytes:
            unit = unit.lower()
            if unit.isascii() and unit.isalpha():
                return array("I", piece(unit.encode() + end)).tobytes()
            ids: list[int] = []
            for word in words(unit):
                ids += piece(word.encode() + end)
            return array("I", ids).tobytes()

        @functools.cache
        def trusted(c: str) -> bool:
            """Whether the shortcut treats a character as the library does, whatever stands beside it."""
            joins = unicodedata.category(c)[0] in "MC" or not unicodedata.is_normalized("NFC", c) or any(lo <= c <= hi for lo, hi in JAMO)
            return not joins and all(shortcut(x) == slow(x).tobytes() for x in (c, c + c, f"a{c}", f"{c}a", f"a{c}a", f"1{c}", f"{c}1", f":{c}", f"{c}:", f"'{c}", f"'s{c}"))

        def miss(unit: str) -> bytes:
            return shortcut(unit) if unit.isascii() or all(c < "\x80" or trusted(c) for c in set(unit)) else slow(unit).tobytes()

        class Units(dict):
            def __missing__(self, unit: str) -> bytes:
                if len(self) >= most:
                    self.clear()
                ids = miss(unit)
                if len(unit) <= 64:
                    self[unit] = ids
                return ids

        units = Units()
        odd = re.compile("[\x1c-\x1f]")  # white space to str.split, but not to the tokenizer

        def encode(text: str) -> np.ndarray:
            if odd.search(text):
                return slow(text)
            return np.frombuffer(b"".join(map(units.__getitem__, text.split())), np.uint32)

        # Of each character: SPACE to OTHER where the pass over many texts covers it, else AWAY, or UNKNOWN until it is met.
        kinds, lowered = np.full(0x110000, UNKNOWN, np.uint8), np.arange(0x110000, dtype=np.uint32)
        kind_of = regex.compile(r"(\s)|(\p{L})|(\p{N})|(.)", regex.DOTALL).match

        def meet(points: np.ndarray) -> None:
            for point in points.tolist():
                c = chr(point)
                small = c.lower()
                covered = len(small) == 1 and not odd.match(c) and (c < "\x80" or trusted(c))
                kinds[point], lowered[point] = (kind_of(small).lastindex - 1, ord(small)) if covered else (AWAY, point)

        meet(np.arange(128))

        def points_of(texts: list[str]) -> np.ndarray:
            """The characters of all texts, each with a line's end behind it."""
            return np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)

        def uncovered(texts: list[str]) -> set[int]:
            """Which texts have characters that the pass over many texts doesn't cover."""
            points = points_of(texts)
            if len(new := points[kinds[points] == UNKNOWN]):
                meet(np.unique(new))
            away = np.flatnonzero(kinds[points] == AWAY)
            ends = np.cumsum([len(x) + 1 for x in texts])
            return set(np.searchsorted(ends, away, "right").tolist())

        def cut_up(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
            """The words of all texts end to end, cut by their characters' kinds all at once, and how many each text has."""
            points = points_of(texts)
            kind, points = kinds[points], lowered[points]
            first = np.ones(len(points) + 1, bool)  # where a word or a run of white space begins
            np.not_equal(kind[1:], kind[:-1], out=first[1:-1])
            first[:-1] |= kind == NUMBER
            # 's and its like: an apostrophe that is a run of its own takes one or two letters from the word behind it
            quote = np.flatnonzero(points[:-1] == ord("'"))
            quote = quote[first[quote] & (kind[quote + 1] == LETTER)]
            one, two = points[quote + 1], points[quote + 2]
            taken = np.isin(one, ONE).astype(np.int64)
            for x, y in TWO:
                taken[(one == x) & (two == y)] = 2
            quote, taken = quote[taken > 0], taken[taken > 0]
            first[quote + 1] = False
            first[quote + 1 + taken] = True
            at = np.flatnonzero(first)
            is_word = kind[at[:-1]] != SPACE
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(at)[is_word])])
            raw = np.frombuffer(points[kind != SPACE].tobytes().decode("utf-32-le").encode(), np.uint8)
            if len(raw) > offsets[-1]:  # from characters to bytes
                offsets = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))[offsets]
            words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            ends = np.cumsum([len(x) + 1 for x in texts])
            return words.dictionary_encode(), np.diff(np.searchsorted(at[:-1][is_word], ends), prepend=0)

        def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Each distinct word is encoded once."""
            ends = np.cumsum([len(x) + 1 for x in texts])
            at = np.unique(np.concatenate([np.zeros(1, np.int64), np.searchsorted(ends, np.arange(PASS, int(ends[-1]), PASS)), [len(texts)]])) if texts else []
            parts = [cut_up(texts[lo:hi]) for lo, hi in pairwise(at)]
            if not sum(len(words) for words, _ in parts):
                return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
            coded = pa.chunked_array([words for words, _ in parts]).unify_dictionaries()
            distinct = coded.chunk(0).dictionary
            _, off, data = distinct.buffers()
            word_ends = np.frombuffer(off, np.int64)[1 : len(distinct) + 1]
            spaced = np.insert(np.frombuffer(data, np.uint8)[: word_ends[-1]], word_ends, end[0])
            found = encoding.encode_to_numpy(spaced.tobytes().decode(), disallowed_special=())
            length = np.diff(np.flatnonzero(closes[found]), prepend=-1)
            begin = np.cumsum(length) - length
            ids, counts = [], []
            for words, (_, n_words) in zip(coded.chunks, parts, strict=True):
                of_word = words.indices.to_numpy()
                size = length[of_word]
                total = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
                ids.append(found[np.repeat(begin[of_word] - total[:-1], size) + np.arange(total[-1])])
                counts.append(np.diff(total[np.cumsum(n_words)], prepend=0))
            return np.concatenate(ids), np.concatenate(counts)

        # the end is merged with its byte before any other merge, so that each word has one id that closes it
        if all(len(x.removesuffix(end)) < 2 for x in sorted(ranks, key=ranks.get)[:512]) and sum(end in x[:-1] for x in ranks) == 1:
            self.joined, self.uncovered = joined, uncovered
        return encode


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
