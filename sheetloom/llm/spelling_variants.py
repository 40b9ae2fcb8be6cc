"""Spelling variants: words of the corpus at distance one, found by a trie self-join with active nodes, and their usual forms."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, split_join, spread, use_checkpoints

#: Words are runs of these; one in TYPO_EVERY has a letter deleted; words count from LEAST_LENGTH letters and LEAST_N occurrences on.
LETTERS, TYPO_EVERY, LEAST_LENGTH, LEAST_N = r"[A-Za-zÀ-ÿ]+", 199, 6, 5
#: A near word is a word's form if it is so many times as frequent.
FORM_TIMES = 5
#: Words of one trie; larger parts of the vocabulary are cut further.
TRIE_WORDS = 4096


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all whole texts, counted in each task before the shuffle. Null texts have no words; a null id is empty text."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({LETTERS})"), F.lit(1)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", F.translate("run", ascii_uppercase, ascii_lowercase).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    hashed = runs.filter(F.length("run") >= LEAST_LENGTH).select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % TYPO_EVERY == 0, short).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_N))


class Node:
    """The words lo to hi of a sorted list, which share their first depth letters."""

    __slots__ = ("depth", "hi", "kids", "lo")

    def __init__(self, lo: int, hi: int, depth: int):
        self.lo, self.hi, self.depth, self.kids = lo, hi, depth, None

    def ends(self, words: list[str]) -> bool:
        return len(words[self.lo]) == self.depth

    def children(self, words: list[str]) -> dict[str, Node]:
        if self.kids is None:
            self.kids = {}
            at = self.lo + self.ends(words)
            while at < self.hi:
                letter, first = words[at][self.depth], at
                while at < self.hi and words[at][self.depth] == letter:
                    at += 1
                self.kids[letter] = Node(first, at, self.depth + 1)
        return self.kids


def trie_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j), both ways, of all words at distance one; words are sorted and distinct.

    Each node's active nodes are those at distance one from its letters. A child's come from its parent's: the parent
    (its letter deleted), its siblings (replaced), its own children (inserted), and the children of the parent's active
    nodes by the same letter. A node of one word asks its active nodes for the rest of that word."""
    root = Node(0, len(words), 0)
    stack = [(root, list(root.children(words).values()))] if words else []
    while stack:
        node, active = stack.pop()
        kids = node.children(words)
        for letter, kid in kids.items():
            near = {id(node): node}
            near |= {id(k): k for k in kids.values() if k is not kid}
            if kid.hi - kid.lo > 1:
                near |= {id(k): k for k in kid.children(words).values()}
            for m in active:
                k = m.children(words).get(letter)
                if k is not None and k is not kid:
                    near[id(k)] = k
            if kid.hi - kid.lo == 1:
                rest, found = words[kid.lo][kid.depth :], set()
                for m in near.values():
                    whole = words[m.lo][: m.depth] + rest
                    at = bisect_left(words, whole, m.lo, m.hi)
                    if at < m.hi and words[at] == whole and at != kid.lo:
                        found.add(at)
                for at in found:
                    yield kid.lo, at
                continue
            if kid.ends(words):
                for m in near.values():
                    if m.ends(words):
                        yield kid.lo, m.lo
            stack.append((kid, list(near.values())))


def _shares(before: DataFrame) -> DataFrame:
    """Two rows for each membership: in the part of the vocabulary with the same first half of the core, and with the same second half.

    A membership has a word, the length of the shorter word of its pairs (size), and the core in which they may differ, all but
    head letters in front and tail behind. An edit lies in the second half, or else the first halves differ and the second
    ones agree; apart tells by how many letters in front the words of a pair must not agree."""
    half = F.floor((F.col("size") - F.col("head") - F.col("tail")) / 2).cast("int")
    first = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"), F.col("apart").alias("apart"))
    second = F.struct(F.col("head").alias("head"), (F.col("size") - F.col("head") - half).alias("tail"), (F.col("head") + half).alias("apart"))
    rows = before.select("word", "n", "size", F.inline(F.array(first, second)))
    front, back = F.substring(F.col("word"), F.lit(1), F.col("head")), F.substring(F.col("word"), F.length("word") - F.col("tail") + 1, F.col("tail"))
    return rows.withColumn("part", F.concat_ws("|", "size", "head", "tail", "apart", front, back))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of near words and the commonest one for every word of a part, parts one after the other."""

    def near(rows: list[tuple]) -> Iterator[tuple]:
        size, head, tail, apart = rows[0][3:7]
        cores = sorted((r[1][head : len(r[1]) - tail], r[1], r[2]) for r in rows)
        count, best = {}, {}
        for i, j in trie_pairs([c[0] for c in cores]):
            (_, u, _), (_, v, n) = cores[i], cores[j]
            if min(len(u), len(v)) == size and not (apart and u[:apart] == v[:apart]):
                count[u] = count.get(u, 0) + 1
                best[u] = min(best.get(u, (0, "")), (-n, v))
        for u, k in count.items():
            yield u, k, -best[u][0], best[u][1]

    def groups() -> Iterator[list[tuple]]:
        rows = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("part", "word", "n", "size", "head", "tail", "apart")), strict=True):
                if rows and rows[0][0] != row[0]:
                    yield rows
                    rows = []
                rows.append(row)
        if rows:
            yield rows

    out = []
    for rows in groups():
        out += near(rows)
        if len(out) >= 1 << 14:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["word", "n_near", "near_n", "near"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(word, n_near, near_n, near) of the words (word, n, distinct) that differ from others by one inserted, deleted or replaced letter.

    near is the commonest such word, the smallest of equal ones. The vocabulary is cut by the first halves of words, and
    by the second halves for pairs that differ in the first, for each length of a pair's shorter word, so a word is in four
    parts and each pair in exactly one. Parts of over trie_words words are cut again by halves of what is left, until
    one letter is; such parts stay small by themselves. Words shorter than least_length are left out."""
    shortest = F.explode(F.array(F.length("word"), F.length("word") - 1))
    members = words.select("word", "n", shortest.alias("size")).filter(F.col("size") >= least_length)
    members = members.select("*", *(F.lit(0).alias(c) for c in ("head", "tail", "apart")))
    found = None
    while True:
        members = materialise(_shares(members))
        sizes = members.groupBy("part").agg(F.count("*").alias("members")).filter("members > 1")
        sized = split_join(members, materialise(sizes.withColumn("weight", F.col("members"))), ["part"], "weight")
        small = (F.col("members") <= trie_words) | (F.col("size") - F.col("head") - F.col("tail") <= 1)
        tries = spread(sized.filter(small).drop("members"), "part").sortWithinPartitions("part")
        pairs = materialise(tries.mapInArrow(_joined, "word string, n_near long, near_n long, near string"))
        found = pairs if found is None else found.unionByName(pairs)
        members = sized.filter(~small).drop("members", "part")
        if members.isEmpty():
            break
    first = F.min(F.struct((-F.col("near_n")).alias("down"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.down")).alias("near_n"), F.col("first.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form): the end of the chain of forms. Chains are doubled, so rounds are few."""
    links = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = step.drop("moved")
        if step.filter("moved").isEmpty():
            return links


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus.

    form is the commonest near word, the smallest of equal ones in code-point order, if it occurs FORM_TIMES as often or
    more; root is where the forms from word end, word itself without a form. n_near counts near words. Null texts have no
    words, repeated rows count each, an empty table gives no rows, words of any length are whole, other columns are ignored."""
    use_checkpoints(docs.sparkSession)
    words = materialise(vocabulary(docs, id_col, text_col))
    form: Column = F.col("near_n") >= FORM_TIMES * F.col("n")
    nodes = words.join(near_words(words), "word", "left")
    nodes = materialise(nodes.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("near")).alias("form"), F.when(form, F.col("near_n")).alias("form_n")))
    ends = roots(nodes.filter("form is not null"))
    return nodes.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same by deletion variants of every word; the checksum is its definition by bytes.
SQL = r"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (
    SELECT doc_id, run, count(*) AS n
    FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (
    SELECT run, n, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda s: CASE WHEN ord(s) < 128 THEN [CAST(ord(s) AS BIGINT)] ELSE [CAST(192 | (ord(s) >> 6) AS BIGINT), CAST(128 | (ord(s) & 63) AS BIGINT)] END)) AS b
    FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, bits),
words AS MATERIALIZED (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
    UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
nodes AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
    FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM nodes UNION ALL SELECT walk.word, nodes.word, nodes.form FROM walk JOIN nodes ON walk.next = nodes.word)
SELECT n.word, n.form, walk.root, n.n, n.n_near, n.form_n FROM nodes n JOIN walk ON n.word = walk.word AND walk.next IS NULL
"""
