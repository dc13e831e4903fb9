"""Spellings of people's and organisations' names linked to one entity.

A name is read as an anchor (a given name, or an organisation's trade) and a
core (the surname, or the organisation's own name). The distance of two names is
the larger of the true edit distances of their anchors and of their cores, and
the metric space is partitioned on the anchors' side, where it has few and well
separated pivots:

- Established given names and trades are pivots and their own cells. They differ
  by definition, so only other anchors are replicated to them: a typed anchor to
  each of them within its radius. Nicknames, initials and abbreviations, which no
  radius reaches, are further replicas.
- Every other anchor is assigned to its nearest pivot among the distinct ones of
  its kind, and replicated to each pivot p with d(x, p) <= d(x, nearest) + 2r. By
  the triangle inequality any two within the radius r meet in the cell of either.

Inside a cell an exact radius join links anchors and cores; a cell that is too
large is cut into blocks which meet two by two, each two in a group of its own.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrid.llm.edit import abbreviates, edit_distance
from notegrid.operators.analytics import components
from notegrid.tables import cut_lineage

#: Most frequent words that can be established, and pivots among the other anchors (by a
#: hash): the bound of what is collected and broadcast. Other words and anchors are
#: linked all the same, by the radius join; with fewer pivots, cells are larger.
ANCHOR_WORDS = 8_192
#: A word is established by so many different names.
ESTABLISHED = 3
#: A word within the radius of one that is so many times as frequent is a misspelling of it.
DOMINATED = 20
#: A word that abbreviates one which is so many times as frequent is an abbreviation of it.
ABBREVIATED = 3
#: Nodes of a cell, or of a block of it, that are joined at a time.
CELL_NODES = 16_384

# Legal forms, titles and other words that aren't part of a name.
LEGAL_FORMS = {"inc", "incorporated", "co", "company", "corp", "corporation", "ltd", "limited", "llc", "gmbh", "ag", "plc", "sa", "bv", "kk", "pty", "oy", "ab"}
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "mx", "miss", "sir", "phd", "md", "jr", "sr", "ii", "iii", "esq", "the", "of", "and", "님", "씨", "매니저", "대리", "과장", "부장", "팀장", "이사", "대표"}
# Short forms of given names.
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "andy": "andrew", "angie": "angela", "annie": "anne", "art": "arthur", "barb": "barbara",
    "barbie": "barbara", "bea": "beatrice", "becky": "rebecca", "ben": "benjamin", "benny": "benjamin", "bernie": "bernard", "bert": "albert lambert robert herbert",
    "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "carol": "carolyn", "cathy": "catherine",
    "charlie": "charles", "chris": "christopher", "chuck": "charles", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah",
    "dick": "richard", "dom": "dominic", "don": "donald", "dot": "dorothy", "dottie": "dorothy", "drew": "andrew", "ed": "edward", "eddie": "edward", "ellie": "eleanor",
    "fran": "frances franklin", "frank": "franklin francis", "fred": "frederick", "freddie": "frederick winifred", "freddy": "frederick", "gabe": "gabriel", "gene": "eugene",
    "gerry": "gerald", "gert": "gertrude", "greg": "gregory", "hal": "harold", "hank": "henry", "harry": "harold henry", "issy": "isabel", "izzy": "isabel", "jack": "jacob john",
    "jake": "jacob", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "jon": "jonathan",
    "judy": "judith", "kate": "catherine katrina", "kathy": "catherine", "katie": "catherine katrina", "ken": "kenneth", "kenny": "kenneth", "kit": "christopher",
    "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "liz": "elizabeth", "lou": "louis", "maggie": "margaret", "mandy": "amanda", "marge": "margaret",
    "marty": "martha martin", "matt": "matthew", "max": "maximilian", "meg": "margaret", "mick": "michael", "mike": "michael", "nate": "nathaniel", "nat": "nathaniel", "ned": "edward",
    "nell": "eleanor", "nick": "nicholas", "nicky": "nicholas", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "peg": "margaret", "peggy": "margaret",
    "percy": "percival", "pete": "peter", "phil": "philip", "pippa": "philippa", "rae": "rachel", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert",
    "ron": "ronald", "rosie": "rosalind", "roz": "rosalind", "sam": "samuel", "seb": "sebastian", "sol": "solomon", "steve": "stephen", "sue": "susan", "susie": "susan",
    "ted": "theodore edward", "theo": "theodore", "tim": "timothy", "tina": "valentina christina", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "trish": "patricia",
    "val": "valentina", "vic": "victor", "vince": "vincent", "walt": "walter", "wally": "walter", "will": "william", "winnie": "winifred", "zach": "zachary", "zack": "zachary",
}


def plain_words(name: str) -> tuple[list[str], list[str], bool]:
    """(words, words typed with an abbreviation's dot, has a legal form) of a name,
    in the order of speech: what stands before a comma goes last."""
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", name))
    text = "".join(ch for ch in text if unicodedata.category(ch) not in ("Mn", "Cf"))
    text = unicodedata.normalize("NFC", text)
    text = re.sub(r"\(.*?\)", " ", text).replace("님", " 님")
    text = re.sub(r"\b(?:\w\.){2,}\w?(?!\w)", lambda m: m[0].replace(".", ""), text)  # G.m.b.H. but not a.bcd
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z]{2})", " ", text)
    legal = False
    parts = []
    for part in text.split(","):
        found = re.findall(r"[^\W_]+\.?", part)
        kept = [w for w in found if w.rstrip(".").lower() not in LEGAL_FORMS]
        legal |= len(kept) < len(found)
        if kept:
            parts.append(kept)
    words = [w for part in parts[1:] + parts[:1] for w in part]
    dotted = [w.rstrip(".").lower() for w in words if w.endswith(".") and len(w) > 2]
    words = [w.rstrip(".").lower() for w in words]
    words = [w for i, w in enumerate(words) if w not in TITLES]
    return words, [w for w in dotted if w in words], legal


def anchor_radius(length: int) -> int:
    """Edits between two spellings of an anchor of so many letters."""
    return 0 if length < 4 else 1 if length < 8 else 2


def other_short_name(a: str, b: str) -> bool:
    """Four letters of which one is another (joan, john) are two names; turned ones (jonh) are a slip."""
    return len(a) == len(b) == 4 and sorted(a) != sorted(b)


class Anchors:
    """Established given names and words of trades."""

    def __init__(self, given: list[str], trades: list[str]):
        self.given = sorted({*given, *(g for gs in NICKNAMES.values() for g in gs.split())} - set(NICKNAMES))
        self.known_given = set(self.given) | set(NICKNAMES)
        # a frequent word that abbreviates a longer one is no pivot of its own
        self.trades = sorted(t for t in set(trades) if not any(t != u and len(t) < 6 and abbreviates(t, u) for u in trades))
        self.trade_set = set(self.trades)
        self.near: dict[str, tuple[list[str], bool]] = {}
        self.near_trade: dict[str, list[str]] = {}

    def given_pivots(self, word: str) -> tuple[list[str], bool]:
        """(pivots the word may belong to, whether it is sure to be a given name)."""
        if word in NICKNAMES:
            own = [g for g in NICKNAMES[word].split()]
            # a nickname may also be a misspelt name, as jon for joan
            return own + [g for g in self.given if abs(len(g) - len(word)) <= 1 and g not in own and edit_distance(g, word) <= 1], True
        if word in self.known_given:
            return [word], True
        if word not in self.near:
            if len(word) == 1:
                hit = [g for g in self.given if g[0] == word]
            else:
                r = anchor_radius(len(word))
                by = [(edit_distance(g, word), g) for g in self.given if abs(len(g) - len(word)) <= r]
                hit = [g for d, g in by if d <= r and not other_short_name(word, g)] if r else []
            if len(self.near) > 100_000:
                self.near.clear()
            self.near[word] = (hit, False)
        return self.near[word]

    def trade_pivots(self, word: str, dotted: bool) -> list[str]:
        """Trade words that the word is, abbreviates or misspells."""
        if word in self.trade_set:
            return [word]
        if (word, dotted) not in self.near_trade:
            hits = [(abbreviates(word, t), t) for t in self.trades] if dotted or len(word) > 2 else []
            best = [[t for c, t in hits if c == level] for level in (1, 2)]
            out = best[0] or best[1]
            if not out and len(word) > 3:
                out = [t for t in self.trades if abs(len(t) - len(word)) <= 2 and edit_distance(t, word) <= (2 if len(word) >= 8 else 1)]
            if len(self.near_trade) > 100_000:
                self.near_trade.clear()
            self.near_trade[word, dotted] = out
        return self.near_trade[word, dotted]

    def readings(self, name: str) -> list[tuple[str, str, str, bool]]:
        """(kind, anchor, core, sure) for each anchor that the name may have; sure if it
        can have no other. Kinds: g and o have an established given name or trades as
        the anchor, r another given name, i an initial, n is a name that is only itself."""
        words, dotted, legal = plain_words(name)
        if not words:
            return [("n", "", name, True)]
        if legal or "&" in name:
            dotted = dotted + [w for w in words if len(w) == 1]
        given = [i for i, w in enumerate(words) if w in self.known_given and w not in dotted]
        if legal or not given:
            org = self._organisation(words, dotted, legal)
            if org:
                return org
        return self._person(words, given)

    def _organisation(self, words: list[str], dotted: list[str], legal: bool) -> list[tuple[str, str, str, bool]]:
        if len(words) == 1:
            tail = next((t for t in self.trades if len(t) >= 5 and words[0].endswith(t) and len(words[0]) - len(t) >= 4), None)
            if tail:
                return [("o", tail, words[0][: -len(tail)], True)]
            return [("o", "", words[0], True)] if legal else []
        meant = [self.trade_pivots(w, w in dotted) for w in words]
        core = [w for w, m in zip(words, meant) if not m]
        if not core:  # every word could be one of a trade: the first one is the name
            core, meant[0] = [words[0]], []
        if not any(meant):
            return [("o", "", "".join(words), True)] if legal else []
        if not legal and len(core) > 1:
            return []
        if not legal and not dotted and len(words) == 2 and not any(w in self.trade_set for w in words) and min(len(w) for w, m in zip(words, meant) if m) < 3:
            return []
        phrases = sorted({" ".join(sorted(p)) for p in product(*[m for m in meant if m])})
        return [("o", p, "".join(core), len(phrases) == 1) for p in phrases]

    def _person(self, words: list[str], given: list[int]) -> list[tuple[str, str, str, bool]]:
        if len(words) == 1:
            w = words[0]
            out = [("g", g, w[1:], False) for g in self.given if g[0] == w[0]] if len(w) > 4 else []
            out += [("g", p, w[len(g) :], False) for g in self.known_given if len(g) > 2 and w.startswith(g) and len(w) - len(g) >= 4 for p in self.given_pivots(g)[0]]
            return out or [("n", "", w, True)]
        long = [i for i, w in enumerate(words) if len(w) > 1]
        at = next((i for i in given), None)
        if at is None and len(long) == len(words):  # a misspelt given name, else the first word
            close = [i for i in (0, len(words) - 1) if self.given_pivots(words[i])[0]]
            at = close[0] if close else 0
        elif at is None:
            at = next(i for i, w in enumerate(words) if len(w) == 1) if len(long) < 2 else long[0]
        core = "".join(w for i, w in enumerate(words) if i != at and len(w) > 1)
        if not core:
            return [("n", "", " ".join(words), True)]
        pivots, _ = self.given_pivots(words[at])
        if len(words[at]) == 1:
            return [("g", p, core, False) for p in pivots] + [("i", words[at], core, False)]
        out = [("g", p, core, len(pivots) == 1) for p in pivots]
        if not pivots:
            out = [("r", words[at], core, True)]
            if len(words) == 2:  # which of the two is the given name can't be told
                out.append(("r", core, words[at], True))
        return out


class AnchorSpace:
    """Pivots among anchors that aren't established; cells(x) by the triangle inequality."""

    def __init__(self, pivots: list[str]):
        self.pivots = pivots
        self.size = np.array([len(p) for p in pivots])
        self.mask = np.array([letter_mask(p) for p in pivots], dtype=np.uint64)
        self.known: dict[str, list[str]] = {}

    def _within(self, x: str, radius: int) -> list[tuple[int, str]]:
        near = (np.abs(self.size - len(x)) <= radius) & (np.bitwise_count(self.mask ^ np.uint64(letter_mask(x))) <= 2 * radius)
        found = ((edit_distance(x, self.pivots[i]), self.pivots[i]) for i in np.flatnonzero(near).tolist())
        return sorted(f for f in found if f[0] <= radius)

    def cells(self, x: str) -> list[str]:
        """The cell of the nearest pivot first, then those of all pivots p with d(x, p) <= d(x, nearest) + 2r."""
        if x not in self.known:
            reach, r, hit = 0, anchor_radius(len(x)), self._within(x, 0)
            while not hit:
                reach = 2 * reach + 1
                hit = self._within(x, reach)
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[x] = [p for _, p in self._within(x, hit[0][0] + 2 * r)]
        return self.known[x]


def letter_mask(word: str) -> int:
    bits = 0
    for ch in word:
        bits |= 1 << (ord(ch) % 61)
    return bits


def core_radius(length: int) -> int:
    """Edits between two spellings of a core of so many letters."""
    return 0 if length < 4 else 1 if length < 7 else 2


def shared_variants(words: list[str], numbers: list[int], letters: int) -> np.ndarray:
    """Pairs (i, j), i < j, of words of at most `letters` letters that have a variant in
    common: what is left when up to the radius of letters is taken out. Words within
    the radius share one, whatever the edits are. Variants are 64-bit hashes."""
    hashes, owners = [], []
    by_length: dict[int, list[int]] = {}
    for n in numbers:
        if len(words[n]) <= letters:
            by_length.setdefault(len(words[n]), []).append(n)
    for length, own in by_length.items():
        codes = np.frombuffer("".join(words[n] for n in own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(own), length).astype(np.uint64) + np.uint64(1)
        for out in range(core_radius(length) + 1):
            for gone in combinations(range(length), out):
                h = np.full(len(own), 1469598103934665603, dtype=np.uint64)
                for c in range(length):
                    if c not in gone:
                        h = (h ^ codes[:, c]) * np.uint64(1099511628211)
                        h ^= h >> np.uint64(29)
                hashes.append(h)
                owners.append(np.array(own))
    if not hashes:
        return np.empty((0, 2), dtype=np.int64)
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    at, step, found = np.arange(len(h)), 0, []
    while len(at):
        step += 1
        at = at[at + step < len(h)]
        at = at[h[at + step] == h[at]]
        x, y = owner[at], owner[at + step]
        found.append(np.unique((np.minimum(x, y) * len(words) + np.maximum(x, y))[x != y]))
    code = np.unique(np.concatenate(found))
    return np.stack([code // len(words), code % len(words)], axis=1)


def radius_pairs(cores: list[str], block: int = 2_048, letters: int = 30) -> list[tuple[int, int, int]]:
    """All (i, j, distance), i < j, of cores within the radius of the shorter one.

    Cores of up to `letters` letters are paired by the variants they share, which
    takes time in proportion to their number. The few longer ones, which have too
    many variants, are compared by lower bounds of the edit distance first, in
    blocks of bit operations: lengths differ by at most the radius, and the sets of
    letters by at most twice the radius.
    """
    order = sorted(range(len(cores)), key=lambda i: (len(cores[i]), cores[i]))
    words = [cores[i] for i in order]
    out = []

    def keep(i: int, j: int, r: int) -> None:
        d = edit_distance(words[i], words[j])
        if d <= r:
            out.append((min(order[i], order[j]), max(order[i], order[j]), d))

    size = np.array([len(w) for w in words])
    for i, j in shared_variants(words, list(range(len(words))), letters).tolist():
        r = core_radius(int(size[i]))
        if size[j] - size[i] <= r:
            keep(i, j, r)
    first = int(np.searchsorted(size, letters + 1 - core_radius(letters)))
    mask = np.array([letter_mask(w) for w in words[first:]], dtype=np.uint64)
    for i in range(first, len(words)):
        r = core_radius(int(size[i]))
        end = int(np.searchsorted(size, size[i] + r, side="right"))
        for at in range(max(i + 1, int(np.searchsorted(size, letters + 1))), end, block):
            near = np.flatnonzero(np.bitwise_count(mask[at - first : min(end, at + block) - first] ^ mask[i - first]) <= 2 * r)
            for j in (near + at).tolist():
                keep(i, j, r)
    return out


LINKS = "node string, other string, d int, sure boolean"


def node_name(kind: str, anchor: str, core: str) -> str:
    return f"{kind}:{anchor}|{core}"


def link_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a cell's nodes (kind, anchor, core, sure, block), or of those of two of its
    blocks: every sure node with the least one it is linked to (sure), and each other
    node with its nearest sure node, or with the least other one it is linked to."""
    cores, index = np.unique(pdf.core.to_numpy(dtype=object).astype(str), return_inverse=True)
    kind, anchor, sure, block = pdf.kind.tolist(), pdf.anchor.tolist(), pdf.sure.tolist(), pdf.block.tolist()
    two = len(set(block)) > 1
    nodes_of: list[list[int]] = [[] for _ in cores]
    for n, c in enumerate(index.tolist()):
        nodes_of[c].append(n)
    names = [node_name(k, a, c) for k, a, c in zip(kind, anchor, pdf.core)]
    parent = list(range(len(names)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    nearest: dict[int, tuple[int, str]] = {}

    def link(x: int, y: int, d: int) -> None:
        if two and block[x] == block[y]:
            return
        if kind[x] == kind[y] == "r":
            r = anchor_radius(min(len(anchor[x]), len(anchor[y])))
            if anchor[x] != anchor[y] and (other_short_name(anchor[x], anchor[y]) or abs(len(anchor[x]) - len(anchor[y])) > r or edit_distance(anchor[x], anchor[y]) > r):
                return
        if sure[x] == sure[y]:
            a, b = find(x), find(y)
            if names[a] > names[b]:
                a, b = b, a
            parent[b] = a
        else:  # read only with an unsure anchor: the nearest sure core
            x, y = (x, y) if sure[x] else (y, x)
            if y not in nearest or (d, names[x]) < nearest[y]:
                nearest[y] = d, names[x]

    for same in nodes_of:
        for n, x in enumerate(same):
            for y in same[n + 1 :]:
                link(x, y, 0)
    for i, j, d in radius_pairs(cores.tolist()):
        for x in nodes_of[i]:
            for y in nodes_of[j]:
                link(x, y, d)
    rows = [(names[n], names[find(n)], 0, sure[n]) for n in range(len(names)) if find(n) != n]
    rows += [(names[n], other, d, True) for n, (d, other) in nearest.items()]
    return pd.DataFrame(rows, columns=["node", "other", "d", "sure"])


def established(words: list[tuple[str, int]], shortened: bool = False) -> list[str]:
    """Words that aren't within the radius of one DOMINATED times as frequent, nor (if
    words may be shortened) abbreviate one ABBREVIATED times as frequent; words come
    with their counts."""
    words = sorted(words, key=lambda w: (-w[1], w[0]))
    space = AnchorSpace([w for w, _ in words])
    count = dict(words)
    out = []
    for w, n in words:
        r = anchor_radius(len(w))
        if r and any(count[u] >= DOMINATED * n and u != w for _, u in space._within(w, r)):
            continue
        if shortened and any(m >= ABBREVIATED * n and abbreviates(w, u) for u, m in words):
            continue
        out.append(w)
    return out


def choose_anchors(names: DataFrame) -> Anchors:
    """Established words of all distinct names (column name): trades stand behind
    another word in names with a legal form; given names come first in names of two
    words, more often than last. Given names count by the different words they stand
    with, trades by names."""

    def trade_words(batches):
        for pdf in batches:
            read = ((name, *plain_words(name)) for name in pdf["name"])
            rows = [(w, name, True) for name, words, _, legal in read if legal for w in words[1:] if len(w) > 1]
            yield pd.DataFrame(rows, columns=["word", "beside", "first"], dtype=object)

    def given_names(batches):
        for pdf in batches:
            rows = []
            for name in pdf["name"]:
                words, dotted, legal = plain_words(name)
                if not legal and not dotted and len(words) == 2 and len(words[0]) > 1 and not no_given.trade_pivots(words[1], False):
                    rows += [(words[0], words[1], True), (words[1], words[0], False)]
            yield pd.DataFrame(rows, columns=["word", "beside", "first"], dtype=object)

    def frequent(f) -> list[tuple[str, int]]:
        pairs = names.select("name").mapInPandas(f, "word string, beside string, first boolean").distinct()
        counts = pairs.groupBy("word").agg(F.count_if("first").alias("n"), F.count_if(~F.col("first")).alias("last"))
        often = counts.where((F.col("n") >= ESTABLISHED) & (F.col("n") > 2 * F.col("last")))
        return [(r.word, r.n) for r in often.orderBy(F.desc("n"), "word").limit(ANCHOR_WORDS).collect()]

    trades = established(frequent(trade_words), shortened=True)
    no_given = Anchors([], trades)
    return Anchors([w for w in established(frequent(given_names)) if w not in set(trades)], trades)


def link_names(names: DataFrame) -> DataFrame:
    """(name, entity): for every distinct string of the column name the entity it means.

    Names with different given names, or organisations of different trades, are
    never linked. A name that fits several entities equally well (an initial, a
    nickname) is an entity of its own. Null and blank names are left out.
    """
    spark = names.sparkSession
    # by number: adaptive execution would put small rows that take long in one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    strings = cut_lineage(names.select("name").where(F.length(F.trim("name")) > 0).distinct().repartition(tasks, F.xxhash64("name")))
    anchors = spark.sparkContext.broadcast(choose_anchors(strings))

    def read(batches):
        for pdf in batches:
            rows = [(name, *r) for name in pdf["name"] for r in anchors.value.readings(name)]
            yield pd.DataFrame(rows, columns=["name", "kind", "anchor", "core", "sure"])

    node = F.concat(F.col("kind"), F.lit(":"), F.col("anchor"), F.lit("|"), F.col("core")).alias("node")
    readings = cut_lineage(strings.mapInPandas(read, "name string, kind string, anchor string, core string, sure boolean"))
    nodes = readings.where(F.col("kind") != "n").groupBy("kind", "anchor", "core").agg(F.max("sure").alias("sure"))
    others = readings.where(F.col("kind") == "r").select("anchor").distinct()
    space = spark.sparkContext.broadcast(AnchorSpace([r.anchor for r in others.orderBy(F.xxhash64("anchor"), "anchor").limit(ANCHOR_WORDS).collect()]))

    def place(batches):
        for pdf in batches:
            rows = []
            for k, a, c, s in zip(pdf.kind, pdf.anchor, pdf.core, pdf.sure):
                cells = [f"r:{p}" for p in space.value.cells(a)] + ["i:" + a[0]] if k == "r" else [f"{k}:{a}"]
                rows += [(cell, k, a, c, s) for cell in cells]
            yield pd.DataFrame(rows, columns=["cell", "kind", "anchor", "core", "sure"])

    placed = nodes.mapInPandas(place, "cell string, kind string, anchor string, core string, sure boolean")
    # cells above CELL_NODES are cut in blocks by core, of which every two meet
    large = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_NODES).cast("int").alias("blocks")).where("blocks > 1")
    blocks = placed.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("core"), F.col("blocks")).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = blocks.withColumns({"lo": F.least("block", "met"), "hi": F.greatest("block", "met")}).select("cell", "lo", "hi", "kind", "anchor", "core", "sure", "block")
    links = cut_lineage(groups.repartition(tasks, "cell", "lo", "hi").groupBy("cell", "lo", "hi").applyInPandas(link_group, LINKS))

    sure_nodes = nodes.where("sure").select(node.alias("node")).withColumn("home", F.lit(True))
    between = links.join(sure_nodes, "node", "left").withColumn("home", F.coalesce("home", F.lit(False)))
    united = between.where(F.col("home") == F.col("sure")).select(F.col("node").alias("src"), F.col("other").alias("dst"))
    # a name read both ways round is one name
    twice = readings.where(F.col("kind") == "r").groupBy("name").agg(F.min(node).alias("src"), F.max(node).alias("dst")).where("src <> dst").select("src", "dst")
    linked_nodes = united.union(twice)
    label = components(linked_nodes, linked_nodes.select(F.explode(F.array("src", "dst")).alias("name")).distinct())
    nearest = between.where(~F.col("home") & F.col("sure")).groupBy("node").agg(F.min(F.struct("d", "other")).alias("best")).select("node", "best.d", "best.other")

    rows = readings.select("name", node, "kind").join(sure_nodes, "node", "left").join(nearest, "node", "left")
    meant = F.when(F.col("home") | (F.col("kind") == "n"), F.col("node")).otherwise(F.coalesce("other", "node"))
    d = F.when(F.col("home") | (F.col("kind") == "n"), 0).otherwise(F.coalesce("d", F.lit(99)))
    rows = rows.select("name", meant.alias("meant"), d.alias("d")).join(label.select(F.col("name").alias("meant"), "component"), "meant", "left")
    rows = rows.select("name", "d", F.coalesce("component", "meant").alias("entity"))
    best = rows.withColumn("least", F.min("d").over(Window.partitionBy("name"))).where(F.col("d") == F.col("least"))
    return best.groupBy("name").agg(
        F.when((F.countDistinct("entity") == 1) | (F.min("d") == 99), F.min("entity")).otherwise(F.concat(F.lit("name:"), F.col("name"))).alias("entity")
    )


def vault_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Names of people and organisations: contacts, and the targets of two relations."""
    contacts = nodes.where(F.col("source") == "contacts").select("name")
    targets = edges.where(F.col("relation").isin("participants", "organization")).select(F.col("target_name").alias("name"))
    return contacts.union(targets)


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: different strings of one entity."""
    a = linked.select("entity", F.col("name").alias("name_a"))
    b = linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
