"""BPE encoding and decoding through a minimal acyclic transducer.

The most frequent words of the corpus (counted over all documents) are compiled, with the ids that BPE gives
them, into a minimal automaton over UTF-8 bytes in which words share prefixes and suffixes. Every edge holds
the number of words left of it, so a path adds up to the word's number, which selects its ids. The automaton is
one flat buffer: a broadcast of bounded size (`LEXICON_WORDS` words) that each worker memory-maps. Words
that it doesn't hold are merged exactly, pair by pair in rank order.

No word crosses ASCII white space, so texts are split there first and each different token is looked up once; a worker process keeps
its model and what it looked up from task to task, in two generations of bounded size: the newer one takes what is used.
Tokens of ASCII and other common Latin letters, digits and signs, which the normaliser only lower-cases, are split here; all others go
through the vocabulary file's normaliser and word pattern as the library has them, so both know the same characters.

Defined cases
* null or empty text: no tokens; the digests are those of the empty string.
* repeated rows and null ids: every row is encoded by itself. Empty table: empty result.
* special tokens written in a text become their ids, as the tokenizers library does by default.
* very long tokens: merged through a heap, in time n log n; they aren't remembered, which bounds a worker's memory.
* other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import os
import re
import struct
from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, ship, table, written

LEXICON_WORDS = 50_000
#: Entries of a worker's memos of finished words and tokens, of at most so many bytes each; when half of them are new, the older go.
MEMO_WORDS, MEMO_BYTES = 600_000, 64
#: Texts whose characters are all common, and their words once they are in lower case: the file's pattern for just these characters.
COMMON = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
COMMON_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u017f]+|[0-9]|[^a-z0-9\u00df-\u017f]+").findall
#: Stands for the end of a word; no UTF-8 text has this byte.
END_BYTE = b"\xff"
#: Symbols of a word beyond which pairs are kept in a heap.
LONG_WORD = 64


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Apart(dict):
    """(token, next token or None) -> whether exact merging of their letters gives just these."""

    def __init__(self, model: WordBpe):
        self.model = model

    def __missing__(self, pair):
        if len(self) >= MEMO_WORDS:
            self.clear()
        ids = [i for i in pair if i is not None]
        word = b"".join(self.model.spelt[i] for i in ids)
        ends = word[-1:] == END_BYTE
        out = self[pair] = self.model.merged(self.model.symbols(word[: len(word) - ends], ends)) == ids
        return out


class Memo(dict):
    """word -> make(word); those used lately are remembered, at most `MEMO_WORDS` of at most `MEMO_BYTES` bytes."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, word: bytes):
        out = self.older.get(word) or self.make(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


class WordBpe:
    """The vocabulary file's model: normaliser, word pattern, merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        end = model["end_of_word_suffix"] or ""
        # symbols are numbers: those of the vocabulary, and further ones for bytes that it lacks
        alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        spare = iter(range(max(self.tokens) + 1, 1 << 31))
        number = lambda t: self.vocab[t] if t in self.vocab else next(spare)
        self.inner, self.last = ([number(c + e) for c in alphabet] for e in ("", end))
        self.known = frozenset(self.tokens)
        #: pair of symbols -> rank and merged symbol, as one number
        self.merges: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[self.vocab[a], self.vocab[b]] = rank << 32 | self.vocab[a + b]
        self.apart, self.propose = Apart(self), self._proposer(end)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        rules = Tokenizer.from_file(path)
        self.normalised, self.split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str

    def _proposer(self, end: str):
        """tiktoken on the same vocabulary, with the end of a word as a byte that no text has; it goes by merged tokens instead of pairs."""
        import tiktoken

        #: token -> its bytes, with END_BYTE for the end of a word
        self.spelt = {i: bytes(self.byte_of[c] for c in (t.removesuffix(end) if end else t)) + END_BYTE * bool(end and t.endswith(end)) for t, i in self.vocab.items()}
        ranks = {w: i for i, w in self.spelt.items()}
        if len(ranks) < len(self.vocab) or any(bytes([b]) not in ranks for b in range(256)) or not end:
            return None
        return tiktoken.Encoding("words", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def pieces(self, text: str) -> list[bytes]:
        """Words in order; a special token stands as itself, led by a zero byte."""
        if "<|" in text and len(parts := self.cut.split(text)) > 1:
            return [w for k, p in enumerate(parts) for w in ([b"\0" + p.encode()] if k % 2 else self._words(p))]
        return self._words(text)

    def _words(self, text: str) -> list[bytes]:
        byte_of = self.byte_of
        return [bytes([byte_of[c] for c in w]) for w, _ in self.split(self.normalised(text))] if text else []

    def words_of(self, token: bytes) -> list[bytes]:
        """Words of a text without white space."""
        if token.isalpha():  # true for ASCII letters only
            return [token.lower()]
        text = token.decode("utf-8", "surrogatepass")
        if COMMON(text) and "<|" not in text:
            return [w.encode() for w in COMMON_WORDS(text.lower())]
        return self.pieces(text)

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one word: of the pairs of least rank the leftmost is merged, again and again.

        A faster merger proposes the tokens. They are right if and only if every two neighbours are what exact merging makes of
        their own letters, since then no merge crosses a boundary; that is looked up for every two. Else the word is merged here."""
        if word[:1] == b"\0" and (name := word[1:].decode()) in self.special:
            return [self.special[name]]
        if len(word) > LONG_WORD:
            return self._merge_long(word)
        if self.propose:
            ids = self.propose(word + END_BYTE)
            apart = self.apart
            if all([apart[p] for p in zip(ids, ids[1:])]) if len(ids) > 1 else apart[ids[0], None]:
                return ids
        return [p for p in self.merged(self.symbols(word, True)) if p in self.known]

    def symbols(self, word: bytes, ends: bool) -> list[int]:
        parts = [self.inner[b] for b in word]
        if ends:
            parts[-1] = self.last[word[-1]]
        return parts

    def merged(self, parts: list[int]) -> list[int]:
        merges, none = self.merges, 1 << 62
        ranks = [merges.get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            k = ranks.index(least)
            parts[k : k + 2] = [least & 0xFFFFFFFF]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = merges.get((parts[k], parts[k + 1]), none)
            if k:
                ranks[k - 1] = merges.get((parts[k - 1], parts[k]), none)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        """The same through a heap of (rank, place) over a linked list; entries that no longer hold are skipped."""
        merges, parts = self.merges, self.symbols(word, True)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            found, k = heapq.heappop(heap)
            j = after[k]
            if parts[k] < 0 or j >= n or merges.get((parts[k], parts[j])) != found:
                continue
            parts[k], parts[j] = found & 0xFFFFFFFF, -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (more := merges.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (more, left))
        return [p for p in parts if p >= 0 and p in self.known]

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False) without a decoder: the tokens joined by spaces."""
        return " ".join(self.tokens[i] for i in ids)


class Lexicon:
    """Minimal acyclic automaton of words with id outputs, in one buffer."""

    def __init__(self, buffer):
        n_edges, n_states, n_words, n_ids = struct.unpack_from("<4I", buffer, 0)
        at, fields = 16, []
        for kind, n in (("<u4", n_states + 1), ("<u4", n_edges), ("<u4", n_edges), ("<u4", n_words + 1), ("<u4", n_ids), ("u1", n_states), ("u1", n_edges)):
            fields.append(np.frombuffer(buffer, kind, n, at))
            at += fields[-1].nbytes
        # plain memory views index faster than arrays
        self.first, _, _, self.ids_at, self.ids, self.final = (memoryview(f) for f in fields[:6])
        # (state, byte) -> words left of the edge and its target, as one number each: an edge is found at once
        state = np.repeat(np.arange(n_states, dtype="i8"), np.diff(fields[0].astype("i8")))
        self.edges = dict(zip((state << 8 | fields[6]).tolist(), (fields[2].astype("i8") << 32 | fields[1]).tolist()))

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Over an anonymous memory-mapped file; nothing is left on disk."""
        fd = os.memfd_create("lexicon")
        os.write(fd, data)
        view = mmap.mmap(fd, len(data), prot=mmap.PROT_READ)
        os.close(fd)
        return cls(view)

    @staticmethod
    def compiled(words: dict[bytes, list[int]]) -> bytes:
        """Sorted words, one by one; finished branches are replaced by equal ones seen before."""
        register: dict[tuple, int] = {}
        kept: list[tuple] = []  # (final, ((byte, state), ...)) of the registered states
        path: list[list] = [[False, []]]  # open states along the last word
        last = b""

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, edges = path.pop()
                key = (final, tuple(edges))
                if key not in register:
                    register[key] = len(kept)
                    kept.append(key)
                path[-1][1][-1] = (path[-1][1][-1][0], register[key])

        order = sorted(words)
        for data in order:
            common = len(os.path.commonprefix([last, data]))
            close(common)
            for b in data[common:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            last = data
        close(0)
        kept.append((path[0][0], tuple(path[0][1])))
        count = [0] * len(kept)
        first, target, left, label, final = [0], [], [], [], []
        for k, (end, edges) in enumerate(kept):  # targets come before their sources
            below = int(end)
            for b, to in edges:
                label.append(b)
                target.append(to)
                left.append(below)
                below += count[to]
            count[k] = below
            first.append(len(label))
            final.append(int(end))
        ids = [words[w] for w in order]
        at = np.cumsum([0, *map(len, ids)]).astype("<u4")
        flat = np.array([i for x in ids for i in x], "<u4")
        arrays = [np.array(first, "<u4"), np.array(target, "<u4"), np.array(left, "<u4"), at, flat, np.array(final, "u1"), np.array(label, "u1")]
        return struct.pack("<4I", len(label), len(kept), len(order), len(flat)) + b"".join(a.tobytes() for a in arrays)

    def get(self, word: bytes) -> list[int] | None:
        edge, state, number = self.edges.get, len(self.first) - 2, 0
        for b in word:
            if (to := edge(state << 8 | b)) is None:
                return None
            number += to >> 32
            state = to & 0xFFFFFFFF
        return self.ids[self.ids_at[number] : self.ids_at[number + 1]].tolist() if self.final[state] else None


def frequent_words(docs: DataFrame, path: str, limit: int = LEXICON_WORDS) -> list[bytes]:
    """The words of all documents that are at least as frequent as a count which no more than `limit` words reach."""

    def counted(batches):
        model, tokens = model_of(path), Counter()

        def counts():
            words = Counter()
            for token, n in tokens.items():
                for w in [token.lower()] if token.isalpha() else model.words_of(token):
                    words[w] += n
            return _counts(words)

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    tokens.update(t.encode("utf-8", "surrogatepass").split())
                    if len(tokens) > 500_000:
                        yield counts()
                        tokens = Counter()
        yield counts()

    ship(docs.sparkSession)
    rows = docs.select("text").mapInArrow(counted, "word binary, n long").filter(F.octet_length("word").between(1, MEMO_BYTES))
    # steps of a sixteenth of a power of two: at most 1024 of them, whatever the corpus
    step = F.floor(F.log2("n") * 16).cast("int")
    words = written(rows.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").select("word", step.alias("step")), "words")
    total, least = 0, None
    for r in sorted(words.groupBy("step").agg(F.count("*").alias("k")).collect(), key=lambda r: -r.step):
        total += r.k
        if total > limit:
            break
        least = r.step
    return [] if least is None else [bytes(r.word) for r in words.filter(F.col("step") >= least).select("word").collect()]


def _counts(words: Counter):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"word": pa.array(words.keys(), pa.binary()), "n": pa.array(words.values(), pa.int64())})


@functools.lru_cache(maxsize=1)
def model_of(path: str) -> WordBpe:
    """One a process: its tables take longer to build than many a task takes."""
    return WordBpe(path)


class Encoder:
    """How the ids of words and tokens and their decoding look."""

    def __init__(self, path: str, lexicon: bytes):
        self.model, self.known = model_of(path), Lexicon.mapped(lexicon)
        self.shown = {i: str(i) for i in self.model.tokens}
        self.words, self.tokens = Memo(self._word), Memo(self._token)

    def _word(self, word: bytes) -> tuple[str, str]:
        ids = self.known.get(word)
        if ids is None:
            ids = self.model.merge(word)
        shown, tokens = self.shown, self.model.tokens
        return " ".join([shown[i] for i in ids]), " ".join([tokens[i] for i in ids])

    def _token(self, token: bytes) -> tuple[str, str]:
        if token.isalpha():  # one word, as in `words_of`
            return self.words[token.lower()]
        found = [self.words[w] for w in self.model.words_of(token)]
        if len(found) == 1:
            return found[0]
        found = [x for x in found if x[0]]  # some words have no ids
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found])


#: The last encoder of this process, by vocabulary file and digest of its lexicon.
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, digest: str, lexicon) -> Encoder:
    """That of a broadcast lexicon."""
    found = _ENCODERS.get((path, digest))
    if found is None:
        _ENCODERS.clear()
        found = _ENCODERS[path, digest] = Encoder(path, lexicon.value)
    return found


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (optional), n_tokens, ids_sha256, decoded_sha256 of every row."""
    model = model_of(path)
    words = {w: model.merge(w) for w in frequent_words(docs, path)}
    data = Lexicon.compiled(words)
    lexicon, digest = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    def make():
        look_up = encoder(path, digest, lexicon).tokens.__getitem__

        def encoded(doc_id, text):
            found = list(map(look_up, (text or "").encode("utf-8", "surrogatepass").split()))
            shown = [x[0] for x in found]
            if "" in shown:  # some tokens have no ids
                found = [x for x in found if x[0]]
                shown = [x[0] for x in found]
            ids, back = " ".join(shown), " ".join([x[1] for x in found])
            out = (doc_id, ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
            yield (*out, list(map(int, ids.split()))) if with_ids else out

        return encoded

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
