"""BPE encoding and decoding over a trie of distinct words.

A worker inserts the distinct words of a slice of texts into a trie and walks it depth
first.  Each prefix has the last token of its encoding: the encoding of a prefix is
that of the prefix before its last token, plus that token.  The last token is the
longest suffix that is a token and may follow the last token of what precedes it.  So
a shared prefix is worked out once, and no merge list is applied to any word.

Whether one token may follow another depends on the two alone: undoing their merges
from the latest to the earliest, no merge across their border may come before the
ones undone.  Answers are kept in a table.  A worker keeps its vocabulary and answers
from task to task, and words within a task; their numbers are bounded, and what is left out is
worked out again.

Defined results: a null text is an empty one, with no tokens; rows stay as they are,
so repeated ids give repeated rows; texts of any length are encoded whole.  Output
columns that the input has already replace it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cellwatch.llm.shared import giving_back, slices

#: Distinct words a worker keeps; beyond that, it goes on with those of the slice at hand.
MOST_WORDS = 200_000
#: Pairs of tokens whose answer is kept.
MOST_PAIRS = 200_000
#: White_Space of Unicode, fixed values.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where the characters that stand for a byte at a word's end begin; the private use area.
_LAST = 0xE000
_END = ""  # the key of a word's end in the trie


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a vocabulary file with word ends.

    Inside, a token's text is one character for each of its first pieces; a last
    piece with the word end is a character of its own.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.texts = {i: t for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.texts.update({i: t for t, i in self.special.items()})
        self.pattern = regex.compile(next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.ids = {self.pieces(t): i for t, i in ids.items()}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair: order, token
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: order, pair
        for order, pair in enumerate(model["merges"]):
            left, right = (ids[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            token = ids[self.texts[left] + self.texts[right]]
            self.merged[left, right] = order, token
            self.parts.setdefault(token, (order, left, right))
        self.backward: dict = {}  # tokens by their characters from the last to the first
        for text, token in self.ids.items():
            node = self.backward
            for c in reversed(text):
                node = node.setdefault(c, {})
            node[_END] = token
        self.known_follows: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def pieces(self, text: str) -> str:
        if text.endswith(self.end) and text != self.end:
            body = text[:-len(self.end)]
            return body[:-1] + chr(_LAST + ord(body[-1]))
        return text

    def merge(self, ids: list[int]) -> list[int]:
        """The plain way, by merges: only for single tokens."""
        ids = list(ids)
        while len(ids) > 1:
            order, at = min((self.merged.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(ids, ids[1:])))
            if order == 1 << 60:
                break
            ids[at:at + 2] = [self.merged[ids[at], ids[at + 1]][1]]
        return ids

    def is_whole(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token."""
        known = self._whole.get(token)
        if known is None:
            known = self.merge([self.ids[c] for c in self.pieces(self.texts[token])]) == [token]
            self._whole[token] = known
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand after ``left`` in an encoding; ``known_follows`` has the answers so far."""
        found = self.known_follows[left << 32 | right] = self.is_whole(right) and self._border_holds(left, right)
        return found

    def _border_holds(self, left: int, right: int) -> bool:
        """Undo merges, latest first; ``before`` is the time before which no border merge may happen.

        Of merges with the same order the left one happens first, so a merge across the
        border loses to an equal one in ``left`` and wins against an equal one in ``right``.
        """
        before = 2 << 60
        while True:
            across = self.merged.get((left, right))
            if across is not None and 2 * across[0] + 1 < before:
                return False
            left_parts, right_parts = self.parts.get(left, (-1,)), self.parts.get(right, (-1,))
            if left_parts[0] < 0 and right_parts[0] < 0:
                return True
            if left_parts[0] > right_parts[0]:
                left, before = left_parts[2], 2 * left_parts[0]
            else:
                right, before = right_parts[1], 2 * right_parts[0] + 2


@lru_cache(maxsize=1)
def vocabulary_of(path: str) -> Vocabulary:
    """The vocabulary of a worker, for all its tasks."""
    return Vocabulary(path)


def encode_words(words: list[str], vocabulary: Vocabulary) -> dict[str, list[int]]:
    """Token ids of distinct words, given as pieces: one walk over their trie, depth first."""
    trie: dict = {}
    for word in words:
        node = trie
        for c in word:
            below = node.get(c)
            if below is None:
                below = node[c] = {}
            node = below
        node[_END] = word
    found: dict[str, list[int]] = {}
    path: list[str] = []  # characters of the prefix; for each, its last token and where that begins
    tokens: list[int] = []
    begins: list[int] = []
    backward, follows, is_whole, known = vocabulary.backward, vocabulary.follows, vocabulary.is_whole, vocabulary.known_follows
    todo = [(0, c, below) for c, below in trie.items()]
    while todo:
        depth, c, node = todo.pop()
        del path[depth:], tokens[depth:], begins[depth:]
        path.append(c)
        at, suffix, options = depth, backward.get(c), []
        while suffix is not None:
            token = suffix.get(_END)
            if token is not None:
                options.append((at, token))
            at -= 1
            if at < 0:
                break
            suffix = suffix.get(path[at])
        for at, token in reversed(options):
            if at:
                fits = known.get(tokens[at - 1] << 32 | token)
                if fits is None:
                    fits = follows(tokens[at - 1], token)
            else:
                fits = is_whole(token)
            if fits:
                tokens.append(token)
                begins.append(at)
                break
        else:
            raise ValueError(f"no token ends in {c!r}")
        depth += 1
        for c, below in node.items():
            if c != _END:
                todo.append((depth, c, below))
                continue
            ids, at = [], depth
            while at > 0:
                ids.append(tokens[at - 1])
                at = begins[at - 1]
            found[below] = ids[::-1]
    return found


class Codec:
    """Texts to token ids, with the words met so far kept."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary_of(path)
        symbols = byte_symbols()
        self.inner = symbols
        self.last = [chr(_LAST + ord(s)) for s in symbols]
        self.space = regex.compile(f"[{WHITE_SPACE}]+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.vocabulary.special)) + ")") \
            if self.vocabulary.special else None
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def keep(self, words: set[str]) -> None:
        """Forget all words but these, and answers if there are too many."""
        self.ids = {w: x for w, x in self.ids.items() if w in words}
        self.decoded = {w: x for w, x in self.decoded.items() if w in words}
        if len(self.vocabulary.known_follows) > MOST_PAIRS:
            self.vocabulary.known_follows.clear()

    def learn(self, words: set[str]) -> None:
        pieces = {}
        for word in words:
            raw = word.encode()
            pieces["".join([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]])] = word
        texts = self.vocabulary.texts
        for piece, ids in encode_words(list(pieces), self.vocabulary).items():
            word = pieces[piece]
            self.ids[word] = " ".join(map(str, ids))
            self.decoded[word] = " ".join(map(texts.__getitem__, ids))

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens.

        White space is for the pattern only what Unicode calls so, and lower case goes
        character by character, without a final sigma.
        """
        from unicodedata import is_normalized, normalize

        if not text.isascii():
            if not is_normalized("NFC", text):
                text = normalize("NFC", text)
            text = self.space.sub(" ", text.replace("\u03a3", "\u03c3"))
        return self.vocabulary.pattern.findall(text.lower())

    def encode_all(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text the number of tokens, the ids joined by a space, and the decoded text."""
        special = self.special
        parts = []
        for text in texts:
            text = text or ""
            plain = special is None or special.search(text) is None
            parts.append([self.words(text)] if plain else [
                self.vocabulary.special[p] if p in self.vocabulary.special else self.words(p) for p in special.split(text)])
        met = set()
        for part in parts:
            for words in part:
                if not isinstance(words, int):
                    met.update(words)
        new = met - self.ids.keys()
        if len(self.ids) + len(new) > MOST_WORDS:
            self.keep(met)
        self.learn(new)
        names, known, decoded = self.vocabulary.texts, self.ids.__getitem__, self.decoded.__getitem__
        rows = []
        for part in parts:
            both = [(str(x), names[x]) if isinstance(x, int) else (" ".join(map(known, x)), " ".join(map(decoded, x)))
                    for x in part]
            ids = " ".join(x for x, _ in both if x)
            rows.append((ids.count(" ") + 1 if ids else 0, ids, " ".join(d for i, d in both if i)))
        return rows


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """Tokens joined by a space, as a file without a decoder asks for; unknown ids are passed over."""
    return " ".join(vocabulary.texts[i] for i in ids if i in vocabulary.texts)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           with_ids: bool = True) -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids`` and ``decoded``."""
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    added = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    if with_ids:
        added += [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]
    names = {f.name.lower() for f in added}
    kept = [docs.schema[c] for c in keep if c.lower() not in names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary_path(vocabulary))
        for batch in (part for whole in batches for part in slices(whole, text, 2 << 20)):
            rows = codec.encode_all(batch.column(text).to_pylist())
            columns = [batch.column(f.name) for f in kept] + [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string()),
                pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string())]
            if with_ids:
                columns += [pa.array([list(map(int, r[1].split())) for r in rows], pa.list_(pa.int32())),
                            pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + [f.name for f in added])

    names_needed = list(dict.fromkeys([f.name for f in kept] + [text]))
    return docs.select(*names_needed).mapInArrow(giving_back(work), StructType(kept + added))
