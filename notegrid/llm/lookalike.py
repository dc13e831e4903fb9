"""Texts that look the same brought to one form.

Words are read as typed by a weighted edit automaton that walks a trie of the
corpus's frequent spellings: a look-alike for a character and a dropped ignorable
cost nothing, and no other edit is within the budget of zero. Of the spellings
reached the most frequent one is canonical, and texts are compared by these.
Words that reach none are normalised by the table. Plain ASCII words, most of a
corpus, are walked once for all when the trie is built: only those change of
which a look-alike is more frequent.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.tables import cut_lineage

#: Spellings in the trie: the most frequent ones of the corpus; the bound of what is broadcast.
VOCABULARY = 65_536
#: Longest spelling in the trie.
SPELLING_CHARS = 48
CACHE_SIZE = 200_000

# Letters of other alphabets that have the shape of a Latin letter.
_SHAPES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "У": "Y", "Ԛ": "Q", "Ԝ": "W",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "‐": "-", "‑": "-", "µ": "μ",
}
#: Letters and marks that show nothing although their category isn't Cf or Cc.
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}
_BREAKS = "\n\r\x0b\x0c\x85\u2028\u2029"
_JOINERS = "\u200c\u200d"


@lru_cache(maxsize=None)
def _ignorable(ch: str) -> bool:
    """Shows nothing by itself. Joiners may show in some scripts; see `drop_joiners`."""
    kind = unicodedata.category(ch)
    return kind == "Cf" or ord(ch) in _INVISIBLE or 0xE0100 <= ord(ch) <= 0xE01EF or kind == "Cc" and ch not in _BREAKS and ch != "\t"


@lru_cache(maxsize=None)
def shape(ch: str) -> str:
    """The characters that a reader sees for ch, '' for an ignorable one. Width
    doesn't count; letter case, accents, raised and lowered signs do."""
    if ch in _JOINERS:
        return ch
    if _ignorable(ch):
        return ""
    if ch == "\t" or unicodedata.category(ch) == "Zs" or ch == "⠀":
        return " "
    kind = unicodedata.decomposition(ch).partition(" ")[0]
    if kind in ("<wide>", "<narrow>", "<noBreak>") or 0xFB00 <= ord(ch) <= 0xFB06:
        return "".join(shape(c) for c in unicodedata.normalize("NFKC", ch))
    apart = unicodedata.normalize("NFD", ch)
    if len(apart) > 1 or apart != ch:
        return unicodedata.normalize("NFC", "".join(_SHAPES.get(c, c) for c in apart))
    return _SHAPES.get(ch, ch)


def drop_joiners(text: str) -> str:
    """Zero-width joiners removed except where they change what is shown: after a
    virama and between pictographs."""
    if not any(j in text for j in _JOINERS):
        return text
    out = []
    for i, ch in enumerate(text):
        if ch in _JOINERS:
            before = out[-1] if out else ""
            after = next((c for c in text[i + 1 :] if c not in _JOINERS), "")
            virama = before and unicodedata.combining(before) == 9
            pictures = before and after and ord(before) >= 0x2190 and ord(after) >= 0x2190 and unicodedata.category(before)[0] == "S" and unicodedata.category(after)[0] == "S"
            if not (virama or pictures):
                continue
        out.append(ch)
    return "".join(out)


def table_form(text: str) -> str:
    """The text in the table's shapes, composed; equal for texts that look the same."""
    if text.isascii():
        return text if text.isprintable() else "".join(map(shape, text))
    # composed before and after, so that a base letter and its mark meet whatever stood between them
    seen = "".join(shape(c) for c in unicodedata.normalize("NFC", drop_joiners(text)))
    apart = "".join(_SHAPES.get(c, c) for c in unicodedata.normalize("NFD", seen))
    return unicodedata.normalize("NFC", apart)


def units(ch: str) -> str:
    """What the automaton reads for one typed character: the decomposed characters
    that are seen, of plain width and in the shapes of the table; '' for an ignorable."""
    return "".join(_SHAPES.get(c, c) for c in unicodedata.normalize("NFD", shape(ch)))


class SpellingTrie:
    """Frequent spellings as a trie, walked by a weighted edit automaton.

    A state is a node of the trie with the cost so far. Edges that put a look-alike
    (another alphabet, another width, composed for decomposed, a ligature for its
    letters) or drop an ignorable cost nothing, any other edit costs 1. States above
    the budget die; with the budget of 0 only spellings that look the same are reached.
    """

    def __init__(self, spellings: list[tuple[str, int]]):
        #: A node is a dict from the shape on an edge to the edges' (character, node); "" holds (count, spelling).
        self.root: dict = {}
        for word, count in spellings:
            node = self.root
            for ch in unicodedata.normalize("NFD", word):
                edges = node.setdefault(_SHAPES.get(ch, ch), [])
                child = next((n for c, n in edges if c == ch), None)
                if child is None:
                    child = {}
                    edges.append((ch, child))
                node = child
            node[""] = (count, word)

    @staticmethod
    def _drop(states: dict, budget: int) -> dict:
        """The states and those reached from them by letters of the spelling that weren't typed."""
        todo = list(states.values())
        while todo:
            node, cost = todo.pop()
            if cost == budget:
                continue
            for label, edges in node.items():
                for _, child in edges if label else ():
                    if states.get(id(child), (None, budget + 1))[1] > cost + 1:
                        states[id(child)] = child, cost + 1
                        todo.append((child, cost + 1))
        return states

    def walk(self, word: str, budget: int = 0) -> tuple[int, str] | None:
        """(cost, spelling): the cheapest, then most frequent, then first spelling within the budget."""
        states = self._drop({id(self.root): (self.root, 0)}, budget)
        for ch in unicodedata.normalize("NFD", word):
            for unit in units(ch):
                after: dict = {}

                def reach(node: dict, cost: int) -> None:
                    if cost <= budget and after.get(id(node), (None, budget + 1))[1] > cost:  # noqa: B023
                        after[id(node)] = node, cost  # noqa: B023

                for node, cost in states.values():
                    for _, child in node.get(unit, ()):
                        reach(child, cost)
                    if cost < budget:
                        reach(node, cost + 1)
                        for label, edges in node.items():
                            for _, child in edges if label and label != unit else ():
                                reach(child, cost + 1)
                states = self._drop(after, budget)
                if not states:
                    return None
        ends = [(cost, -node[""][0], node[""][1]) for node, cost in states.values() if "" in node]
        return (min(ends)[0], min(ends)[2]) if ends else None

    def find(self, word: str) -> str | None:
        """The canonical spelling of a word, None if it looks like none."""
        hit = self.walk(word)
        return hit[1] if hit else None


_SPACES = re.compile("[" + "".join(chr(i) for i in (*range(0x2000, 0x200B), 0x9, 0xA0, 0x1680, 0x202F, 0x205F, 0x2800, 0x3000)) + "]")
_LINE_END = re.compile("\r\n|[\r\x0b\x0c\x85\u2028\u2029]")
#: A word that isn't plain ASCII; it can only start after a space, so that long words aren't tried at every place.
_TYPED_WORD = re.compile(r"(?<![^ \n])[\x21-\x7e]*+[^\x20-\x7e\n][^ \n]*+")
_ANY_WORD = re.compile(r"[^ \n]+")


class Normaliser:
    """Canonical texts: words by the trie, the words it has no spelling of by the table."""

    def __init__(self, spellings: list[tuple[str, int]]):
        self.trie = SpellingTrie(spellings)
        self.known: dict[str, tuple[str, bool]] = {}
        # plain ASCII words stay as they are unless a look-alike of them is more frequent: those are walked here, once
        ascii_forms = {f for w, _ in spellings if not w.isascii() and (f := table_form(w)).isascii()}
        self.moved = {f: form for f in ascii_forms if (form := self.trie.find(f)) is not None and form != f}

    def decide(self, word: str) -> tuple[str, bool]:
        """(form, by the trie)."""
        hit = self.known.get(word)
        if hit is None:
            form = self.trie.find(word)
            if form is None:
                table = table_form(word)
                # a mark parted from its letter is only put in order by the table
                form = self.trie.find(table) if table != word else None
            hit = (form, True) if form is not None else (table, False)
            if len(word) <= SPELLING_CHARS:
                if len(self.known) > CACHE_SIZE:
                    self.known.clear()
                self.known[word] = hit
        return hit

    def _form(self, m: re.Match) -> str:
        word = m[0]
        return self.moved.get(word, word) if word.isascii() and word.isprintable() else self.decide(word)[0]

    @staticmethod
    def lines(text: str) -> str:
        """Line breaks become \\n, every space one plain space; the number of spaces stays."""
        return _SPACES.sub(" ", _LINE_END.sub("\n", drop_joiners(text)))

    def text(self, text: str) -> str:
        text = self.lines(text)
        if self.moved and not self.moved.keys().isdisjoint(text.replace("\n", " ").split(" ")):
            return _ANY_WORD.sub(self._form, text)
        return _TYPED_WORD.sub(self._form, text)


_NORMALISERS: dict[int, Normaliser] = {}


def _normaliser(spellings: list[tuple[str, int]]) -> Normaliser:
    key = id(spellings)
    if key not in _NORMALISERS:
        _NORMALISERS.clear()
        _NORMALISERS[key] = Normaliser(spellings)
    return _NORMALISERS[key]


def plain_spelling(word: str) -> bool:
    """May be canonical: composed, of plain width, without ignorables, and its letters of one alphabet."""
    if unicodedata.normalize("NFC", word) != word or any(shape(c) != c and c not in _SHAPES and not unicodedata.decomposition(c) for c in word):
        return False
    if any(unicodedata.decomposition(c).startswith("<") or not shape(c) for c in word):
        return False
    alphabets = {unicodedata.name(c, "?").split()[0] for c in word if c.isalpha()}
    return len(alphabets & {"LATIN", "CYRILLIC", "GREEK"}) < 2


def frequent_spellings(docs: DataFrame, text_col: str, limit: int = VOCABULARY) -> list[tuple[str, int]]:
    """The `limit` most frequent words of all texts with their counts; words of
    ignorables and of other characters alone can't be told apart and stay out."""
    words = docs.select(F.explode(F.split(text_col, r"(?U)[\s\u2007\u202f\u00a0\p{Cntrl}]+")).alias("w"))
    fits = (F.length("w") > 0) & (F.length("w") <= SPELLING_CHARS) & F.col("w").rlike(r"\p{L}")
    counts = words.where(fits).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    rows = counts.orderBy(F.desc("n"), "w").limit(limit).collect()  # at most `limit` short words
    return [(r.w, r.n) for r in rows if plain_spelling(r.w)]


def normalise_texts(docs: DataFrame, id_col: str, text_col: str, limit: int = VOCABULARY) -> DataFrame:
    """(id, text): every text in its consistent form. Null stays null; a text
    without a visible character becomes blank. Whole texts are read; only the two
    columns are."""
    spellings = docs.sparkSession.sparkContext.broadcast(frequent_spellings(docs, text_col, limit))

    def run(batches):
        form = _normaliser(spellings.value)
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], text_col: [None if t is None else form.text(t) for t in pdf[text_col]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, `{text_col}` string")


def lookalike_classes(docs: DataFrame, id_col: str, text_col: str, limit: int = VOCABULARY) -> DataFrame:
    """(id, class_hi, class_lo, text_hash) of the texts with a visible character:
    texts look the same if both class columns agree (128 bits of the form's MD5)."""
    spellings = docs.sparkSession.sparkContext.broadcast(frequent_spellings(docs, text_col, limit))

    def run(batches):
        import hashlib

        form = _normaliser(spellings.value)
        for pdf in batches:
            ids, hi, lo, raw = [], [], [], []
            for i, t in zip(pdf[id_col], pdf[text_col]):
                seen = form.text(t) if t else ""
                if not seen.strip(" \n"):
                    continue
                digest = hashlib.md5(seen.encode("utf-8", "surrogatepass")).digest()
                ids.append(i)
                hi.append(int.from_bytes(digest[:8], "big", signed=True))
                lo.append(int.from_bytes(digest[8:], "big", signed=True))
                raw.append(int.from_bytes(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True))
            yield pd.DataFrame({"id": ids, "class_hi": hi, "class_lo": lo, "text_hash": raw})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"id {kind}, class_hi long, class_lo long, text_hash long")


def lookalike_pairs(docs: DataFrame, id_col: str, text_col: str, limit: int = VOCABULARY, block: int = 1_024) -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b: texts that differ but look the same.

    Pairs are formed of the distinct texts of a class, and rows are put in last:
    the rows of a text are cut into blocks of about `block`, and every two blocks
    are a join key of their own, so that many copies of two texts are spread over
    tasks. Classes of one text, however many copies, form no pairs. Null and blank
    texts, and those of ignorables alone, are in no pair.
    """
    # several joins read the classes: four numbers a text, written once
    classes = cut_lineage(lookalike_classes(docs, id_col, text_col, limit))
    key = ["class_hi", "class_lo"]
    mixed = classes.groupBy(*key).agg(F.min("text_hash").alias("x"), F.max("text_hash").alias("y")).where("x <> y").select(*key)
    members = classes.join(mixed, key, "left_semi")
    texts = members.groupBy(*key, "text_hash").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    x = texts.select(*key, F.col("text_hash").alias("x"), F.col("blocks").alias("x_blocks"))
    y = texts.select(*key, F.col("text_hash").alias("y"), F.col("blocks").alias("y_blocks"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    pairs = x.join(y, key).where("x < y").withColumn("i", upto("x_blocks")).withColumn("j", upto("y_blocks"))
    placed = members.join(texts, [*key, "text_hash"]).select(*key, "text_hash", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("at"), "id")
    a = placed.withColumnsRenamed({"text_hash": "x", "at": "i", "id": "a"})
    b = placed.withColumnsRenamed({"text_hash": "y", "at": "j", "id": "b"})
    rows = pairs.join(a, [*key, "x", "i"]).join(b, [*key, "y", "j"]).where("a <> b")
    return rows.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def class_rows(docs: DataFrame, id_col: str, text_col: str, limit: int = VOCABULARY) -> DataFrame:
    """(id, class_id, n_docs, n_texts): one row for each text with a visible character:
    the least id of those that look the same, and how many rows and different texts they are."""
    classes = cut_lineage(lookalike_classes(docs, id_col, text_col, limit))
    texts = classes.groupBy("class_hi", "class_lo", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    sizes = texts.groupBy("class_hi", "class_lo").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_texts"))
    return classes.join(sizes, ["class_hi", "class_lo"]).select(F.col("id").alias(id_col), "class_id", "n_docs", "n_texts")


def word_decisions(docs: DataFrame, text_col: str, limit: int = VOCABULARY) -> DataFrame:
    """(decided_by, n_words, n_changed): the words that got their form by a spelling of
    the trie or by the table, and how many of these differ from it, over all texts."""
    spellings = docs.sparkSession.sparkContext.broadcast(frequent_spellings(docs, text_col, limit))

    def run(batches):
        form = _normaliser(spellings.value)
        for pdf in batches:
            n = {True: [0, 0], False: [0, 0]}
            for t in pdf[text_col]:
                for w in _ANY_WORD.findall(form.lines(t)) if t else ():
                    seen, known = form.decide(w)
                    n[known][0] += 1
                    n[known][1] += seen != w
            yield pd.DataFrame([("spelling", *n[True]), ("table", *n[False])], columns=["decided_by", "n_words", "n_changed"])

    counts = docs.select(text_col).mapInPandas(run, "decided_by string, n_words long, n_changed long")
    return counts.groupBy("decided_by").agg(F.sum("n_words").alias("n_words"), F.sum("n_changed").alias("n_changed"))
