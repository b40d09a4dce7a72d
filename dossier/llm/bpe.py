"""BPE encoding and decoding with a lexicon compiled into a minimal acyclic transducer.

The words of a text are what the vocabulary's pattern cuts out of its normalised form. The frequent words of all
documents are compiled, with their token ids, into an automaton that shares prefixes and suffixes: a path spells a word
in UTF-8, its arcs carry the ids, each as near to the root as the words below allow. The automaton is one file in the
shared folder that Spark hands to every executor; its workers map it into memory and walk it for all words of a slice
of text in step. A word that is not in it is merged by the ranks of the vocabulary, so the lexicon decides about speed
alone and never about a result.
"""

import heapq
import itertools
import json
import re
import unicodedata
import uuid

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import folder, stored, write_bytes
from .textops import widened

WORDS = 1 << 16  # most words of the lexicon
WORD_BYTES = 64  # of a word of the lexicon; a longer one is merged
PIECE = 1 << 20  # characters of a text that are cut into words at once
HELD = 300_000  # words that wait for a walk through the automaton, or distinct words that a task counts before it sends them
MEMO = 1 << 16  # merged words a worker remembers
TOGETHER = 1 << 13  # words that are merged in step

#: The pattern of words, the mark at a word's end and the normal form this module knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
NORMAL = ["NFC", "Replace", "Lowercase"]

#: Up to U+0557 Python and the tokenizers library know the same Unicode; texts beyond are cut by that library.
RARE = re.compile("[^\x00-\u0557]")


class Vocabulary:
    """Ids, pieces and ranked merges of a vocabulary file of the tokenizers library with marked word ends."""

    def __init__(self, text):
        content = json.loads(text)
        model, normal, before = content["model"], content["normalizer"], content["pre_tokenizer"]
        if (
            model["end_of_word_suffix"] != END
            or [n["type"] for n in normal["normalizers"]] != NORMAL
            or before["pretokenizers"][0]["pattern"]["Regex"] != PATTERN
            or content["decoder"] is not None
        ):
            raise ValueError("a vocabulary of another kind")
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.pieces = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for piece, i in [*ids.items(), *self.special.items()]:
            self.pieces[i] = piece
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + END] for c in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(ids[a] << 20) | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self._keys = np.array(sorted(self.ranks), np.int64)
        self._key_ranks = np.array([self.ranks[k] for k in self._keys.tolist()], np.int64)
        self._inner, self._last, self._made = (np.array(v, np.int64) for v in (self.inner, self.last, self.made))

    def merged(self, word):
        """The ids of a word (bytes): always the pair of least rank first, of equal ones the leftmost.

        Candidates wait in a heap and neighbours are linked, so a word of n bytes takes n log n steps.
        """
        ids = [*map(self.inner.__getitem__, word[:-1]), self.last[word[-1]]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        waiting = []

        def offer(i, j):
            rank = self.ranks.get((ids[i] << 20) | ids[j])
            if rank is not None:
                heapq.heappush(waiting, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while waiting:
            rank, i, left, right = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in ids if x >= 0]

    def merged_all(self, words):
        """Lists of the ids of many words of up to WORD_BYTES bytes, merged in step: one pair a word and round."""
        out = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        for begin in range(0, len(order), TOGETHER):
            own = order[begin : begin + TOGETHER]
            ids, count = self._in_step([words[i] for i in own.tolist()], size[own])
            for i, row, n in zip(own.tolist(), ids.tolist(), count.tolist()):
                out[i] = row[:n]
        return out

    def _rank(self, left, right):
        """Ranks of pairs; ``none`` where there is no merge or a place is empty (-1)."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._key_ranks[at], len(self.made))

    def _in_step(self, words, size):
        """A matrix of ids, a row a word with -1 behind its end, and how many of a row are ids."""
        width = int(size.max()) + 1
        column = np.arange(width)
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        letters = data[np.minimum(first[:, None] + column, len(data) - 1)]
        ids = np.where(column < size[:, None], self._inner[letters], -1)
        rows = np.arange(len(words))
        ids[rows, size - 1] = self._last[letters[rows, size - 1]]
        count, none = size.copy(), len(self.made)
        ranks = np.full(ids.shape, none)
        ranks[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        live = rows
        while len(live):
            at = ranks[live].argmin(1)
            least = ranks[live, at]
            live, at, least = live[least < none], at[least < none], least[least < none]
            if not len(live):
                break
            behind = np.minimum(column + (column > at[:, None]), width - 1)
            ids[live] = ids[live[:, None], behind]
            ranks[live] = ranks[live[:, None], behind]
            ids[live, at] = self._made[least]
            ids[live, -1] = -1
            ranks[live, at] = self._rank(ids[live, at], ids[live, at + 1])
            ranks[live[at > 0], at[at > 0] - 1] = self._rank(ids[live[at > 0], at[at > 0] - 1], ids[live[at > 0], at[at > 0]])
            count[live] -= 1
        return ids, count


def byte_letters():
    """The visible letter that stands for each byte: printable ones for themselves, the rest in turn from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


# --- words ---------------------------------------------------------------------------------------


class Cutter:
    """Cuts texts into words and special tokens; made once a task."""

    def __init__(self, special):
        import regex

        self.special = special
        self.marks = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.words = regex.compile(PATTERN).findall
        self.plain_words = re.compile(PATTERN.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII).findall
        self.library = None

    def pieces(self, text):
        """Parts of a text whose words are the text's words, in order. A part ends before white space, which no word, no
        normal form and no special token spans; where there is none for long, the part is longer."""
        begin = 0
        gap = re.compile(r"\s")
        while len(text) - begin > PIECE:
            found = gap.search(text, begin + PIECE)
            if not found:
                break
            yield text[begin : found.start()]
            begin = found.start()
        yield text[begin:] if begin else text

    def cut(self, piece):
        """Words as text, special tokens as their ids."""
        out = []
        for part in self.marks.split(piece) if "<|" in piece else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii():
                out += self.plain_words(part.lower())
            elif RARE.search(part):
                out += self._by_library(part)
            else:
                out += self.words(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def _by_library(self, part):
        if self.library is None:
            from tokenizers import Regex, normalizers, pre_tokenizers

            normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
            self.library = normal.normalize_str, pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True).pre_tokenize_str
        normal, words = self.library
        return [w for w, _ in words(normal(part))]


def frequent_words(docs, vocabulary, text="text", most=WORDS):
    """The most frequent words of up to WORD_BYTES bytes over all texts, with their counts: as many whole classes of frequency,
    an eighth of a power of two each, as have no more than ``most`` words together."""
    special = vocabulary.special

    def count(batches):
        cutter, seen = Cutter(special), {}
        for batch in batches:
            for value in batch.column(0):
                for piece in cutter.pieces(value.as_py() or ""):
                    for w in cutter.cut(piece):
                        seen[w] = seen.get(w, 0) + 1
                    if len(seen) > HELD:
                        yield _counts(seen)
                        seen = {}
        yield _counts(seen)

    counted = docs.select(text).mapInArrow(count, "word string, n long")
    total = stored(counted.groupBy("word").agg(F.sum("n").alias("n")))
    rank = F.floor(F.log2("n") * 8)
    least, held = None, 0
    for r in sorted(total.groupBy(rank.alias("rank")).agg(F.count("*").alias("words")).collect(), reverse=True):
        held += r.words
        if held > most:
            break
        least = r["rank"]
    return total.filter(rank >= least) if least is not None else total.limit(0)


def _counts(seen):
    import pyarrow as pa

    kept = {w: n for w, n in seen.items() if isinstance(w, str) and len(w.encode()) <= WORD_BYTES}
    return pa.RecordBatch.from_pydict({"word": pa.array(list(kept), pa.string()), "n": pa.array(list(kept.values()), pa.int64())})


# --- the automaton -------------------------------------------------------------------------------


class Transducer:
    """Arrays of a minimal acyclic transducer; they may be views of a memory-mapped file.

    Arcs are sorted by state * 256 + byte (``arc``). ``at`` and ``n`` say which ids of ``ids`` an arc gives out,
    ``last_at`` (-1: no word ends here) and ``last_n`` which ones a state adds at the end of a word. ``root`` is one number.
    """

    KINDS = {"root": "<i4", "arc": "<i8", "target": "<i4", "at": "<i4", "n": "<i4", "last_at": "<i4", "last_n": "<i4", "ids": "<i4"}

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    @classmethod
    def compiled(cls, words):
        """``words``: pairs of a word (bytes) and its ids, each word once, in the order of their bytes.

        States are made along the newest word only; what the next word leaves behind is final and becomes one with an
        equal state made earlier. Ids move towards the root as far as all words through an arc share them.
        """
        states, known = [], {}
        # an open state: arcs {byte: [target, ids]}, and the ids at a word's end, None where no word ends
        open_ = [({}, None)]

        def closed(state):
            arcs, last = state
            key = (last, tuple((b, t, o) for b, (t, o) in arcs.items()))
            if key not in known:
                known[key] = len(states)
                states.append(key)
            return known[key]

        def close_down_to(depth, word):
            while len(open_) > depth + 1:
                state = open_.pop()
                open_[-1][0][word[len(open_) - 1]][0] = closed(state)

        before = b""
        for word, ids in words:
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            close_down_to(same, before)
            rest = tuple(ids)
            for depth in range(same):
                arc = open_[depth][0][word[depth]]
                shared = 0
                while shared < len(arc[1]) and shared < len(rest) and arc[1][shared] == rest[shared]:
                    shared += 1
                moved, arc[1] = arc[1][shared:], arc[1][:shared]
                rest = rest[shared:]
                if moved:
                    arcs, last = open_[depth + 1]
                    for other in arcs.values():
                        other[1] = moved + other[1]
                    open_[depth + 1] = (arcs, None if last is None else moved + last)
            for depth in range(same, len(word)):
                open_[depth][0][word[depth]] = [None, rest if depth == same else ()]
                open_.append(({}, None))
            open_[-1] = (open_[-1][0], ())
            before = word
        close_down_to(0, before)
        root = closed(open_[0])

        pool, places = [], {(): 0}

        def place(ids):
            if ids not in places:
                places[ids] = len(pool)
                pool.extend(ids)
            return places[ids]

        arcs = [(s * 256 + b, t, place(o), len(o)) for s, (_, out) in enumerate(states) for b, t, o in out]
        lasts = [(-1, 0) if last is None else (place(last), len(last)) for last, _ in states]
        columns = [*zip(*arcs)] or [()] * 4
        data = [[root], *columns, *zip(*lasts), pool]
        return cls(**{name: np.array(values, kind) for (name, kind), values in zip(cls.KINDS.items(), data)})

    def to_bytes(self):
        """The lengths of the arrays, then the arrays, each from a multiple of eight bytes."""
        parts = [np.array([len(getattr(self, k)) for k in self.KINDS], "<i8"), *(getattr(self, k) for k in self.KINDS)]
        return b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)

    @classmethod
    def mapped(cls, path):
        """The automaton in a file, mapped into memory and shared with all other processes that do so."""
        data = np.memmap(path, np.uint8, "r")
        lengths = data[: 8 * len(cls.KINDS)].view("<i8")
        at, arrays = 8 * len(cls.KINDS), {}
        for (name, kind), n in zip(cls.KINDS.items(), lengths.tolist()):
            size = n * np.dtype(kind).itemsize
            arrays[name] = data[at : at + size].view(kind)
            at += size + -size % 8
        return cls(**arrays)

    def look_up(self, words):
        """Whether each word (bytes) is in the lexicon, and for all of them ids as one array with the bounds of each word."""
        n = len(words)
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, n)
        first = np.cumsum(size) - size
        state = np.full(n, self.root[0], np.int64)
        live = np.flatnonzero(size > 0)
        found = np.zeros(n, bool)
        steps = [(np.zeros(0, np.int64),) * 3]
        depth = 0
        while len(live):
            wanted = state[live] * 256 + data[first[live] + depth]
            arc = np.searchsorted(self.arc, wanted)
            there = arc < len(self.arc)
            there[there] = self.arc[arc[there]] == wanted[there]
            live, arc = live[there], arc[there]
            state[live] = self.target[arc]
            steps.append((live, self.at[arc], self.n[arc]))
            depth += 1
            at_end = size[live] == depth
            ended = live[at_end]
            ended = ended[self.last_at[state[ended]] >= 0]
            found[ended] = True
            steps.append((ended, self.last_at[state[ended]], self.last_n[state[ended]]))
            live = live[~at_end]
        who, at, count = (np.concatenate([s[i] for s in steps]).astype(np.int64) for i in range(3))
        use = found[who] & (count > 0)
        who, at, count = who[use], at[use], count[use]
        order = np.argsort(who, kind="stable")  # steps are in the order of depth, so the ids of a word are in order
        who, at, count = who[order], at[order], count[order]
        bounds = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(who, count, n).astype(np.int64), out=bounds[1:])
        return found, self.ids[spread(at, count)], bounds


def spread(at, count):
    """The indexes at[i] .. at[i] + count[i] - 1 of all i, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - count), count)


# --- texts ---------------------------------------------------------------------------------------


class Codec:
    """A vocabulary and the lexicon in the shared folder, ready to encode and decode tables."""

    def __init__(self, spark, vocabulary, lexicon):
        """``lexicon``: pairs of a word (bytes) and its ids."""
        self.spark, self.vocabulary = spark, vocabulary
        self.name = f"lexicon-{uuid.uuid4().hex}"
        path = f"{folder(spark)}/{self.name}"
        write_bytes(spark, path, Transducer.compiled(sorted(lexicon)).to_bytes())
        spark.sparkContext.addFile(path)
        self._vocabulary = spark.sparkContext.broadcast(vocabulary)

    def encode(self, docs, text="text", ids="ids", n="n_tokens", keep=None):
        """The columns ``keep`` (all, unless named) and ``ids`` (BINARY: little-endian unsigned 32-bit integers), ``n`` (LONG).

        Every whole text is encoded, whatever its length; it is cut into words in parts, so beside the text and its ids
        a task holds no more than HELD words. Null and empty texts have no ids. The strings of special tokens in a text
        become those tokens. Of columns named like the new ones (in any letter case) the new ones count. Equal rows have
        equal results; an empty table gives an empty one.
        """
        name, vocabulary = self.name, self._vocabulary

        def run(batches):
            encoder = Encoder(vocabulary.value, Transducer.mapped(SparkFiles.get(name)))
            for values in batches:
                coded = [encoder.add(v or "") for v in values]
                encoder.flush()
                packed = [b"".join(parts) for parts in coded]
                yield packed, [len(p) // 4 for p in packed]

        return _with_columns(docs, text, run, f"`{ids}` binary, `{n}` long", keep)

    def decode(self, coded, ids="ids", text="decoded", keep=None):
        """The columns ``keep`` (all, unless named) and ``text``, the pieces of the ids with a space between. Null or no ids
        give an empty text, an id that the vocabulary does not have is left out, and of a column named like the new one
        the new one counts. An empty table gives an empty one."""
        vocabulary = self._vocabulary

        def run(batches):
            pieces = np.array(vocabulary.value.pieces, object)
            have = np.array([p != "" for p in pieces], bool)
            for values in batches:
                found = (np.frombuffer(v or b"", "<u4") for v in values)
                found = (f[f < len(pieces)] for f in found)
                yield ([" ".join(pieces[f[have[f]]].tolist()) for f in found],)

        return _with_columns(coded, ids, run, f"`{text}` string", keep)


def _with_columns(df, column, run, added, keep=None):
    """``df`` with columns that ``run`` makes of slices of the values of ``column``: about PIECE letters or bytes at a time."""
    rest, schema = widened(df.select(*(F.col(f"`{c}`") for c in keep or df.columns)).schema, added)
    new = [f for f in schema.fields][len(rest) :]

    def mapped(batches):
        import pyarrow as pa

        kept, types = [], [pa.int64() if f.dataType == T.LongType() else pa.binary() if f.dataType == T.BinaryType() else pa.string() for f in new]

        def parts():
            for batch in batches:
                begin, held, values = 0, 0, []
                for i in range(batch.num_rows):
                    values.append(batch.column(0)[i].as_py())
                    held += len(values[-1] or "")
                    if held > PIECE or i == batch.num_rows - 1:
                        kept.append(batch.slice(begin, i + 1 - begin).columns[1:])
                        yield values
                        begin, held, values = i + 1, 0, []

        for columns in run(parts()):
            yield pa.RecordBatch.from_arrays([*kept.pop(), *map(pa.array, columns, types)], schema.names)

    return df.select(F.col(f"`{column}`").alias("__value"), *(F.col(f"`{c}`") for c in rest)).mapInArrow(mapped, schema)


class Encoder:
    """Encodes texts through the automaton; words wait until many of them can be walked together."""

    def __init__(self, vocabulary, lexicon):
        self.vocabulary, self.lexicon, self.cutter = vocabulary, lexicon, Cutter(vocabulary.special)
        self.memo = {}
        self.waiting, self.held = [], 0

    def add(self, text):
        """A list that holds the ids of the text, as bytes in parts, after the next ``flush``."""
        out = []
        for piece in self.cutter.pieces(text):
            words = self.cutter.cut(piece)
            self.waiting.append((out, words))
            self.held += len(words)
            if self.held > HELD:
                self.flush()
        return out

    def flush(self):
        words = list(itertools.chain.from_iterable(w for _, w in self.waiting))
        codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
        number = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
        ids, first, count = self._ids(list(codes))
        at = 0
        for out, own in self.waiting:
            mine = number[at : at + len(own)]
            out.append(ids[spread(first[mine], count[mine])].astype("<u4").tobytes())
            at += len(own)
        self.waiting, self.held = [], 0

    def _ids(self, words):
        """Ids of distinct words and special tokens, and where those of each begin and how many they are."""
        plain = [w.encode() if isinstance(w, str) else b"" for w in words]
        found, ids, bounds = self.lexicon.look_up(plain)
        first, count = bounds[:-1], np.diff(bounds)
        unseen = np.flatnonzero(~found)
        parts = self._unseen([plain[i] or words[i] for i in unseen.tolist()])
        count[unseen] = np.fromiter(map(len, parts), np.int64, len(parts))
        first[unseen] = len(ids) + np.cumsum(count[unseen]) - count[unseen]
        more = np.fromiter(itertools.chain.from_iterable(parts), np.int64, int(count[unseen].sum()))
        return np.concatenate([ids, more]), first, count

    def _unseen(self, words):
        """Ids of words that the lexicon lacks (bytes) and of special tokens (ids)."""
        new = [w for w in words if isinstance(w, bytes) and w not in self.memo]
        short = [w for w in new if len(w) <= WORD_BYTES]
        made = dict(zip(short, self.vocabulary.merged_all(short)))
        made |= {w: self.vocabulary.merged(w) for w in new if len(w) > WORD_BYTES}
        parts = [[w] if isinstance(w, int) else self.memo[w] if w in self.memo else made[w] for w in words]
        if len(self.memo) + len(short) > MEMO:
            self.memo = {}
        self.memo |= {w: made[w] for w in short[:MEMO]}
        return parts


def codec(docs, vocabulary_path, text="text", most=WORDS):
    """A codec whose lexicon holds the most frequent words of all of ``docs``: at most ``most`` words of at most WORD_BYTES
    bytes, so its size does not follow that of the corpus. An empty table has an empty lexicon."""
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = Vocabulary(f.read())
    words = [r.word.encode() for r in frequent_words(docs, vocabulary, text, most).select("word").collect()]
    return Codec(spark, vocabulary, list(zip(words, vocabulary.merged_all(words))))
