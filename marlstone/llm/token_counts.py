"""Token counts: the exact number of tokens at every prefix of a text, from which truncation
and budget questions are answered without encoding again.

The store of a text holds one signed byte a character: by how much the count grows (or falls: "th" may
be two tokens and "the" one) when the prefix takes that character in. A running sum gives
count(text[:i]) for every i, so totals, the longest prefix within a budget and the count of any
prefix need no tokenizer.

Tokens never cross ASCII white space, the end of an ASCII digit or the border of a run of Latin letters in the tokenizer
served here (but for contractions, which are left whole), so a text is cut there into pieces, and the counts of a prefix are those of the whole pieces before it plus
those inside its last piece. Inside a piece the counts come from a dynamic program over prefixes of its
pre-tokens. A byte-pair encoding of s[:i] ends in one token t, and what is before t is the encoding
of s[:i - |t|]; t is the only token that ends there and is compatible with the last token of that shorter
prefix, that is, the pair of them encodes to itself. So

    last[i]  = the compatible token that ends at i
    count[i] = count[i - |last[i]|] + 1

with a second count for tokens that carry the end-of-word mark, which is how a prefix ends. Compatible pairs
and distinct pieces are remembered.

New words are taken in order, so that words that begin alike share rows. Where the normaliser changes
the number of characters, a piece is read by clusters, which the normaliser takes each for itself (a letter with its accents,
say): the program goes on from cluster to cluster, and the prefixes that end inside one go on from the last whole one, so that a
piece of any length takes time in proportion. A special token ends what is before it and starts afresh behind it.
The cuts fit one normaliser and pre-tokenizer (NFC, lower case, words of letters, single digits, runs of signs); tokenizer
files with others are refused.

Null and empty texts have no tokens and an empty store; repeated rows are counted row by row; columns
besides the key and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, tokenizer_path

KNOWN, PAIRS = 500_000, 300_000  # pieces in a generation, and pairs, that a worker remembers: bounds memory, not results
COARSE = re.compile(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D0-9]+[0-9]?|[0-9]")
#: White space; Latin words; signs before a word or white space; anything else up to white space or a digit.
LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
PIECE = re.compile(rf"[\x20\x09-\x0D]+|[{LATIN}]++(?![^\x00-\x7F])|[!-&(-/:-@\[-`{{-~]++(?=[\x20\x09-\x0D{LATIN}]|\Z)|[^\x20\x09-\x0D0-9]+[0-9]?|[0-9]")
#: The normaliser and the pre-tokenizer that the cuts fit.
NORMALISER = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BATCH_CHARS = 1 << 20  # a quarter of the characters whose stores are made at once
LONG = 1000  # characters of a piece that is not remembered
#: What makes one word with an apostrophe that begins one.
CONTRACTED = ("s", "t", "re", "ve", "m", "ll", "d")


class Words:
    """The dynamic program over the prefixes of words; a word shares the rows of what it begins with like the last one.

    A row is [last token, tokens so far, tokens if the word ended here, where the last token begins]; the third is
    found when it is asked for."""

    def __init__(self, vocabulary: dict, merges: list, end: str):
        self.end = end
        self.longest = max(map(len, vocabulary))
        self.rank = {(a, b): k for k, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in merges)}
        self.made = {a + b: (a, b, k) for (a, b), k in self.rank.items()}
        if len(self.made) != len(self.rank):
            raise ValueError("prefix counts need one merge for each token")
        whole = {t for t in vocabulary if self._whole(t)}
        self.inner = frozenset(whole)
        self.closing = frozenset(t[: -len(end)] for t in whole if t.endswith(end)) if end else self.inner
        self.last, self.path = "", [["", 0, 0, 0]]
        self.edges: tuple[dict, dict] = ({}, {})
        self.inside: dict[tuple[str, str], bool] = {}
        self.at_end: dict[tuple[str, str], bool] = {}

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """What stands at an edge of token (0: left, 1: right) while it is merged, each with the rank of the merge that takes it up."""
        if (spine := self.edges[side].get(token)) is None:
            spine, x, until = [], token, float("inf")
            while x is not None:
                spine.append((x, until))
                x, until = (self.made[x][side], self.made[x][2]) if x in self.made else (None, 0)
            self.edges[side][token] = spine
        return spine

    def _apart(self, before: str, token: str) -> bool:
        """No merge across the border of the two comes to its turn; of equal ranks the left one does."""
        for x, until_x in self._edge(before, 1):
            for y, until_y in self._edge(token, 0):
                r = self.rank.get((x, y))
                if r is not None and r < until_x and r <= until_y:
                    return False
        return True

    def _whole(self, token: str) -> bool:
        """Merging the token's symbols gives the token."""
        self.edges = ({}, {})
        todo = [token]
        while todo:
            if made := self.made.get(todo.pop()):
                a, b, rank = made
                for x, until_x in self._edge(a, 1):
                    for y, until_y in self._edge(b, 0):
                        r = self.rank.get((x, y))
                        if r is not None and r < rank and r < until_x and r <= until_y:
                            return False
                todo += [a, b]
        return True

    def _row(self, word: str, i: int, path: list[list]) -> list:
        """The row of word[:i]. One token fits; where the last one began is the best guess."""
        inner, inside = self.inner, self.inside
        for k in (path[-1][3], *range(max(0, i - self.longest), i)):
            t = word[k:i]
            if t in inner and (before := path[k])[1] >= 0:
                pair = (before[0], t)
                if (fits := inside.get(pair)) is None:
                    fits = inside[pair] = not k or self._apart(*pair)
                if fits:
                    return [t, before[1] + 1, None, k]
        return ["", -1, None, i]

    def _ended(self, word: str, i: int, path: list[list]) -> int:
        """Tokens of word[:i], ended as a word."""
        closing, at_end = self.closing, self.at_end
        for k in (path[i][3], *range(max(0, i - self.longest), i)):
            t = word[k:i]
            if t in closing and (before := path[k])[1] >= 0:
                pair = (before[0], t)
                if (fits := at_end.get(pair)) is None:
                    fits = at_end[pair] = not k or self._apart(before[0], t + self.end)
                if fits:
                    return before[1] + 1
        raise ValueError(f"no token ends {word[:i]!r}")

    def counts(self, word: str, wanted: Iterator[int]) -> list[int]:
        """Tokens of word[:i], ended as a word, for i in wanted. The rows of what the last word began with are kept."""
        path, same = self.path, 0
        for a, b in zip(self.last, word):
            if a != b:
                break
            same += 1
        del path[same + 1 :]
        self.last = word
        for i in range(same + 1, len(word) + 1):
            path.append(self._row(word, i, path))
        out = []
        for i in wanted:
            row = path[i]
            if row[2] is None:
                row[2] = self._ended(word, i, path)
            out.append(row[2])
        return out

    def forget(self) -> None:
        for held in (self.inside, self.at_end):
            if len(held) > PAIRS:
                held.clear()


class Growing:
    """One word as it grows by symbols, with the rows that the next symbols can need."""

    def __init__(self, words: Words):
        self.words, self.rows, self.tail = words, [["", 0, 0, 0]], ""  # rows[j] is that of the word less len(rows) - 1 - j symbols

    def copy(self) -> Growing:
        out = Growing(self.words)
        out.rows, out.tail = list(self.rows), self.tail
        return out

    def _best(self, tokens: frozenset, known: dict, rows: list, end: str) -> list | None:
        """The row before the token that ends here, and the token."""
        for n in range(min(len(self.tail), self.words.longest, len(rows)), 0, -1):
            t, before = self.tail[len(self.tail) - n :], rows[len(rows) - n]
            if t in tokens and before[1] >= 0:
                pair = (before[0], t)
                if (fits := known.get(pair)) is None:
                    fits = known[pair] = not before[0] or self.words._apart(before[0], t + end)
                if fits:
                    return [t, before[1] + 1]
        return None

    def push(self, symbols: str) -> None:
        most = self.words.longest
        for x in symbols:
            self.tail = (self.tail + x)[-most:]
            found = self._best(self.words.inner, self.words.inside, self.rows, "")
            self.rows.append([*(found or ["", -1]), None, 0])
            if len(self.rows) > 4 * most:
                del self.rows[: -most - 1]

    def ended(self) -> int:
        """Tokens if the word ends here."""
        if not self.tail:
            return 0
        if self.rows[-1][2] is None:
            found = self._best(self.words.closing, self.words.at_end, self.rows[:-1], self.words.end)
            if found is None:
                raise ValueError(f"no token ends {self.tail!r}")
            self.rows[-1][2] = found[1]
        return self.rows[-1][2]


class Reader:
    """Tokens of a text as it grows by normalised characters: those of whole words, and the word that is open.

    kind: what the open word is made of; begun: an apostrophe that began a word, with the letters behind it that may make one word with it."""

    def __init__(self, counter: PieceCounter):
        self.counter, self.done, self.kind, self.begun, self.word = counter, 0, "", "", Growing(counter.words)

    def copy(self) -> Reader:
        out = Reader(self.counter)
        out.done, out.kind, out.begun, out.word = self.done, self.kind, self.begun, self.word.copy()
        return out

    def count(self) -> int:
        return self.done + self.word.ended()

    def _start(self, kind: str) -> None:
        self.done, self.kind, self.begun, self.word = self.count(), kind, "", Growing(self.counter.words)

    def push(self, text: str) -> None:
        for c in text:
            kind, symbols = self.counter.character(c)
            if self.begun and self.begun[1:] + c in CONTRACTED:
                whole = "".join(self.counter.character(x)[1] for x in self.begun + c)
                self.done -= self.counter.words.counts("'", (1,))[0] if self.begun[1:] else 0  # it had been counted as a word
                self.kind, self.begun, self.word = "", "", Growing(self.counter.words)
                self.done += self.counter.words.counts(whole, (len(whole),))[0]
                continue
            begun = self.begun + c if self.begun == "'" and any(x.startswith(c) for x in CONTRACTED) else ""
            if kind == "space":
                self._start("")
                continue
            if kind == "number" or kind != self.kind:
                apostrophe = c == "'" and self.kind != "sign"
                self._start(kind)
                begun = "'" if apostrophe else begun
            self.begun = begun
            self.word.push(symbols)


class PieceCounter:
    """Piece to the growth of the count at each of its characters; remembers two generations of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, normal, split = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        parts = [x["type"] for x in normal.get("normalizers", [])]
        cuts = [x.get("pattern", {}).get("Regex") for x in split.get("pretokenizers", [])]
        if model["type"] != "BPE" or model.get("ignore_merges") or parts != NORMALISER or cuts != [SPLIT, None]:
            raise ValueError(f"{path}: prefix counts are made for another normaliser and pre-tokenizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.normal, self.split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.words = Words(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]) or any(a != b and a in b for a in self.special for b in self.special):
            raise ValueError(f"{path}: prefix counts are made for plain special tokens, none inside another")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kinds: dict[str, tuple[str, str]] = {}
        self.alone: dict[str, bool] = {}

    def character(self, c: str) -> tuple[str, str]:
        """What a normalised character is to the pre-tokenizer (space, letter, number or sign), and its symbols."""
        if (known := self.kinds.get(c)) is None:
            own = self.split(c)
            kind = "space" if not own else "letter" if len(self.split("a" + c)) == 1 else "number" if len(self.split(c + c)) == 2 else "sign"
            known = self.kinds[c] = (kind, own[0][0] if own else "")
        return known

    def clusters(self, text: str) -> Iterator[str]:
        """Parts of the text that are normalised each for itself."""
        held = ""
        for c in text:
            if held and not self._apart(held, c):
                held += c
                continue
            if held:
                yield held
            held = c
        if held:
            yield held

    def _apart(self, held: str, c: str) -> bool:
        if held.isascii() and c.isascii():
            return True
        if unicodedata.combining(c):  # marks may change places, so all of them stay with their letter
            return False
        if len(held) > 1:
            return self.normal(held + c) == self.normal(held) + self.normal(c)
        if (known := self.alone.get(held + c)) is None:
            known = self.alone[held + c] = self.normal(held + c) == self.normal(held) + self.normal(c)
        return known

    def _clustered(self, text: str) -> list[int]:
        """Tokens of text[:1], text[:2], ...; the text holds no special token."""
        reader, out = Reader(self), []
        for cluster in self.clusters(text):
            for j in range(1, len(cluster)):
                part = reader.copy()
                part.push(self.normal(cluster[:j]))
                out.append(part.count())
            reader.push(self.normal(cluster))
            out.append(reader.count())
        return out

    def prefixes(self, piece: str) -> list[int]:
        """Tokens of piece[:1], piece[:2], ..., whatever it holds."""
        out, done, at = [], 0, 0
        for special in self.specials.finditer(piece):
            begin, end = special.span()
            before = self._clustered(piece[at : end - 1])  # its name short of the last character is plain text
            out += [done + n for n in before]
            done += (before[begin - at - 1] if begin > at else 0) + 1
            out.append(done)
            at = end
        return out + [done + n for n in self._clustered(piece[at:])]

    def learn(self, pieces: set[str]) -> None:
        for piece in sorted(pieces, key=str.lower):
            self.known[piece] = self.older[piece] if piece in self.older else self.growth(piece)
        self.words.forget()

    def _word(self, token: str, chars: str) -> list[int]:
        """Tokens of each prefix of a pre-token; token: chars in byte-level symbols."""
        if len(chars) > 1 and chars[0] == "'" and chars[-1].isalpha():  # cut short, a contraction is two words
            mark = self.words.counts("'", (1,))[0]
            return [mark, *(mark + n for n in self.words.counts(token[1:], range(1, len(token) - 1))), *self.words.counts(token, (len(token),))]
        if len(token) == len(chars):
            return self.words.counts(token, range(1, len(token) + 1))
        return self.words.counts(token, accumulate(len(c.encode()) for c in chars))

    def _program(self, piece: str) -> list[int] | None:
        """Tokens of piece[:1], piece[:2], ...; None if its characters are not those of its normal form."""
        if piece.isascii() and piece.isalpha():
            return self._word(low := piece.lower(), low)
        plain = self.normal(piece)
        if len(plain) != len(piece) or not (piece.isascii() or unicodedata.is_normalized("NFC", piece)) or any(s in piece for s in self.special):
            return None
        counts, done, at = [], 0, 0
        for token, (begin, end) in self.split(plain):
            counts += [done] * (begin - at)
            counts += [done + n for n in self._word(token, plain[begin:end])]
            done, at = counts[-1], end
        return counts + [done] * (len(plain) - at)

    def growth(self, piece: str) -> bytes:
        if piece[0] in " \t\n\r\x0b\x0c":
            return bytes(len(piece))
        counts = self._program(piece)
        if counts is None:
            counts = self.prefixes(piece)
        steps = [b - a for a, b in zip([0, *counts], counts)]
        if max(steps) > 127 or min(steps) < -128:
            raise OverflowError("a character changes the count by more than a byte holds")
        return bytes([x & 255 for x in steps])

    def stores(self, texts: list[str]) -> list[bytes]:
        """One signed byte a character of each text."""
        if len(self.known) > KNOWN:
            self.older, self.known = self.known, {}
        cut = [(COARSE if "<|" in t else PIECE).findall(t) for t in texts]
        new: set[str] = set()
        for pieces in cut:
            new.update(set(pieces).difference(self.known))
        self.learn(new)
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        for piece in new:
            if len(piece) > LONG:
                del self.known[piece]
        for held in (self.kinds, self.alone):
            if len(held) > PAIRS:
                held.clear()
        return out


def counter_of(path: str) -> PieceCounter:
    """The worker's counter for a file: it outlives a task, as the library's module does."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_marlstone_counters", {})
    if path not in held:
        held[path] = PieceCounter(path)
    return held[path]


def running(store: bytes) -> np.ndarray:
    """count(text[:i]) for i = 0, 1, ..."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(store, np.int8), dtype=np.int64)])


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens; counts as of running."""
    return len(counts) - 1 - int(np.argmax(counts[::-1] <= budget))


def prefix_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """key, n_bytes and prefix_growth, the store: binary, one signed byte a character."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    schema = pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("prefix_growth", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = counter_of(path)
        for whole in batches:
            data = whole[1].cast(pa.binary())
            texts, size, start = [], 0, 0
            for k in range(whole.num_rows):
                texts.append((data[k].as_py() or b"").decode("utf-8", "replace"))
                size += len(texts[-1])
                if size > 4 * BATCH_CHARS or k + 1 == whole.num_rows:
                    part = whole.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([part[0], part[2], pa.array(counter.stores(texts), pa.binary())], schema=schema)
                    texts, size, start = [], 0, k + 1
        give_back()

    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("k"), text.alias("t"), F.octet_length(text).cast("long").alias("b"))
    return rows.mapInArrow(count, "k long, n_bytes long, prefix_growth binary").withColumnRenamed("k", key)


def fit_budget(counts: DataFrame, budget: int) -> DataFrame:
    """counts without its store, with n_tokens, over_limit (n_tokens > budget), truncate_at (characters of the
    longest prefix of at most budget tokens) and n_tokens_kept (its tokens), all from the stored counts."""
    names = [c for c in counts.columns if c != "prefix_growth"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema.fields if f.name in names) + ", n_tokens long, over_limit boolean, truncate_at long, n_tokens_kept long"

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for store in batch.column("prefix_growth"):
                n = running(store.as_py() or b"")
                within = longest_within(n, budget)
                rows.append((int(n[-1]), bool(n[-1] > budget), within, int(n[within])))
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, "n_tokens", "over_limit", "truncate_at", "n_tokens_kept"])

    return counts.mapInArrow(answer, schema)
