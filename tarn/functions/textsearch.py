"""Full-text search: documents as maps from lexeme to positions, queries compiled to predicates over them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English stop words (fixed values).
STOP_WORDS = "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()


def stem(w: Column) -> Column:
    """A light suffix stemmer: plurals, -ing, -ed, -ly."""
    w = F.when(w.endswith("sses"), w.substr(F.lit(1), F.length(w) - 2)).when(w.endswith("ies"), F.concat(w.substr(F.lit(1), F.length(w) - 3), F.lit("i"))).when(w.rlike("(?:x|z|ch|sh)es$"), w.substr(F.lit(1), F.length(w) - 2)).when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.regexp_replace(w, "(?<=[a-z]{3})(?:ing|ed|ly)$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def lexemes(text: Column, config: str = "english") -> Column:
    """Lexemes in the order of the text, repeats included."""
    return F.transform(F.filter(words(text), lambda w: ~w.isin(STOP_WORDS)), stem) if config == "english" else words(text)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body refers to it from within its own lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def to_tsvector(text: Column, config: str = "english") -> Column:
    """map<lexeme, positions from 1>, stop words left out (but counted in positions); config `simple` keeps all words as they are.

    Words are sorted once and cut into runs of equal ones.
    """
    placed = F.transform(words(text), lambda w, i: F.struct(w.alias("w"), (i + 1).alias("p")))
    if config == "english":
        placed = F.transform(F.filter(placed, lambda x: ~x["w"].isin(STOP_WORDS)), lambda x: F.struct(stem(x["w"]).alias("w"), x["p"].alias("p")))

    def runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        first = F.filter(places, lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))

        def lexemes(t: Column) -> Column:
            end = lambda k: F.coalesce(F.get(t, k + 1), F.size(s))
            return F.map_from_arrays(F.transform(t, lambda i: F.get(s, i)["w"]), F.transform(t, lambda i, k: F.transform(F.slice(s, i + 1, end(k) - i), lambda x: x["p"])))

        return _bound(first, lexemes)

    # sort_array compares by Spark's own ordering, array_sort by a lambda that is interpreted for each pair
    return F.when(text.isNotNull(), _bound(F.sort_array(placed), runs))


def array_to_tsvector(lexemes: Column) -> Column:
    """A vector of lexemes without positions."""
    distinct = F.array_sort(F.array_distinct(lexemes))
    return F.map_from_arrays(distinct, F.transform(distinct, lambda _: F.array().cast("array<int>")))


def tsvector_to_array(vector: Column) -> Column:
    return F.array_sort(F.map_keys(vector))


def ts_delete(vector: Column, *lexemes: str) -> Column:
    return F.map_filter(vector, lambda k, _: ~k.isin(list(lexemes)))


def tsvector_concat(a: Column, b: Column) -> Column:
    """a || b: positions of b follow the last of a."""
    last = F.coalesce(F.array_max(F.flatten(F.map_values(a))), F.lit(0))
    moved = F.transform_values(b, lambda _, p: F.transform(p, lambda x: x + last))
    empty = F.array().cast("array<int>")
    return F.map_zip_with(a, moved, lambda _, x, y: F.concat(F.coalesce(x, empty), F.coalesce(y, empty)))


def _less(i: int):
    return lambda p: p - i


class Query:
    """A text query; match(vector) is a Column. Combine with &, |, ~."""

    def __init__(self, kind: str, *parts) -> None:
        self.kind, self.parts = kind, parts

    def __and__(self, other: Query) -> Query:
        return Query("and", self, other)

    def __or__(self, other: Query) -> Query:
        return Query("or", self, other)

    def __invert__(self) -> Query:
        return Query("not", self)

    def match(self, vector: Column) -> Column:
        """vector @@ query."""
        if self.kind == "word":
            word, prefix = self.parts
            return F.exists(F.map_keys(vector), lambda k: k.startswith(word)) if prefix else F.map_contains_key(vector, word)
        if self.kind == "phrase":
            starts = [F.transform(F.coalesce(F.try_element_at(vector, F.lit(w)), F.array().cast("array<int>")), _less(i)) for i, w in self.parts[0]]
            return F.size(reduce(F.array_intersect, starts)) > 0
        found = [p.match(vector) for p in self.parts]
        return ~found[0] if self.kind == "not" else reduce((lambda a, b: a & b) if self.kind == "and" else (lambda a, b: a | b), found, F.lit(self.kind == "and"))

    def replace(self, target: Query, substitute: Query) -> Query:
        """ts_rewrite: every part that is `target` becomes `substitute`."""
        if self == target:
            return substitute
        return Query(self.kind, *[p.replace(target, substitute) for p in self.parts]) if self.kind in ("and", "or", "not") else self

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Query) and self.kind == other.kind and self.parts == other.parts

    def __hash__(self) -> int:
        return hash((self.kind, str(self)))

    def __str__(self) -> str:
        """The query as PostgreSQL writes it (its querytree, as all parts can use an index but negations)."""
        if self.kind == "word":
            return f"'{self.parts[0]}'" + ":*" * self.parts[1]
        if self.kind == "phrase":
            at, out = self.parts[0][0][0], ""
            for i, w in self.parts[0]:
                out += (f" <{i - at}> " if i - at > 1 else " <-> " if out else "") + f"'{w}'"
                at = i
            return out
        if self.kind == "not":
            return f"!{self.parts[0]}" if self.parts[0].kind == "word" else f"!( {self.parts[0]} )"
        sign = " & " if self.kind == "and" else " | "
        return sign.join(f"( {p} )" if p.kind == "or" and self.kind == "and" else str(p) for p in self.parts)

    def numnode(self) -> int:
        return 1 if self.kind in ("word", "phrase") else max(0, len(self.parts) - (self.kind != "not")) + sum(p.numnode() for p in self.parts)


def _stem(w: str) -> str:
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-3] + "i"
    elif re.search("(?:x|z|ch|sh)es$", w):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss") and len(w) > 3:
        w = w[:-1]
    return re.sub(r"(?<=[a-z]{3})(?:ing|ed|ly)$", "", w)


def _lexemes(text: str, config: str = "english") -> list[tuple[int, str]]:
    found = [w for w in re.split(r"[^\w]+", text.lower()) if w]
    if config != "english":
        return list(enumerate(found))
    return [(i, _stem(w)) for i, w in enumerate(found) if w not in STOP_WORDS]


def ts_lexize(word: str, config: str = "english") -> list[str]:
    """Lexemes of a word: none for a stop word."""
    return [w for _, w in _lexemes(word, config)]


def plainto_tsquery(text: str, config: str = "english") -> Query:
    return Query("and", *[Query("word", w, False) for _, w in _lexemes(text, config)])


def phraseto_tsquery(text: str, config: str = "english") -> Query:
    found = _lexemes(text, config)
    return Query("phrase", [(i - found[0][0], w) for i, w in found]) if found else Query("and")


def tsquery_phrase(first: Query, second: Query, distance: int = 1) -> Query:
    """first <distance> second, for words and phrases of words."""
    a, b = ([(0, q.parts[0])] if q.kind == "word" else list(q.parts[0]) for q in (first, second))
    return Query("phrase", [*a, *((i + a[-1][0] + distance, w) for i, w in b)])


def websearch_to_tsquery(text: str, config: str = "english") -> Query:
    """Words (all), "phrases", or, and -word."""
    either, every = [], []
    for m in re.finditer(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if m[3] and m[3].lower() == "or":
            either.append(every)
            every = []
            continue
        q = phraseto_tsquery(m[2], config) if m[2] is not None else plainto_tsquery(m[3], config)
        every.append(~q if m[1] else q)
    return Query("or", *[Query("and", *e) for e in [*either, every] if e])


def to_tsquery(text: str, config: str = "english") -> Query:
    """Operators & | ! <-> <n> ( ) and word:*."""
    tokens = re.findall(r"<(?:-|\d+)>|[&|!()]|[^\s&|!()<>]+", text)

    def alternatives(i):
        left, i = conjunction(i)
        while i < len(tokens) and tokens[i] == "|":
            right, i = conjunction(i + 1)
            left = left | right
        return left, i

    def conjunction(i):
        left, i = phrase(i)
        while i < len(tokens) and tokens[i] == "&":
            right, i = phrase(i + 1)
            left = left & right
        return left, i

    def phrase(i):
        left, i = unit(i)
        while i < len(tokens) and tokens[i][0] == "<":
            distance = 1 if tokens[i] == "<->" else int(tokens[i][1:-1])
            right, i = unit(i + 1)
            left = tsquery_phrase(left, right, distance)
        return left, i

    def unit(i):
        if tokens[i] == "!":
            q, i = unit(i + 1)
            return ~q, i
        if tokens[i] == "(":
            q, i = alternatives(i + 1)
            return q, i + 1
        word, _, flag = tokens[i].partition(":")
        return Query("word", _stem(word.lower()) if config == "english" else word.lower(), "*" in flag), i + 1

    return alternatives(0)[0]


#: Weight of a position without a label, and the sum of 1 / n^2 over all n (fixed values).
WEIGHT, ALL_SQUARES = 0.1, 1.64493406685


def ts_rank(vector: Column, words_: list[str], config: str = "english") -> Column:
    """ts_rank of a query that joins words by |: for each the weights of its positions over the squares of their ordinals."""

    def one(w: str) -> Column:
        held = F.try_element_at(vector, F.lit(_stem(w.lower()) if config == "english" else w.lower()))
        n = F.coalesce(F.size(held), F.lit(0))
        squares = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, k: s + 1.0 / (k * k))
        return squares * WEIGHT / ALL_SQUARES

    return reduce(lambda a, b: a + b, map(one, words_)) / len(words_)


def ts_headline(text: Column, words_: list[str], start: str = "<b>", stop: str = "</b>") -> Column:
    pattern = "|".join(re.escape(_stem(w.lower())) for w in words_)
    return F.regexp_replace(text, rf"(?i)\b((?:{pattern})\w*)", f"{start}$1{stop}")


def strip(vector: Column) -> Column:
    return F.array_sort(F.map_keys(vector))


def ts_stat(vectors: Column) -> Column:
    """Rows (word, positions) of a vector; group by word for ndoc and nentry."""
    return F.explode(vectors)


def ts_stat_texts(texts: DataFrame, text: str, config: str = "english") -> DataFrame:
    """ts_stat over to_tsvector(text): word, ndoc, nentry. No vectors are built: all lexemes and the distinct ones of each text are counted in one aggregate."""
    lists = F.array(F.struct(F.lit(False).alias("once"), F.col("w").alias("words")), F.struct(F.lit(True).alias("once"), F.array_distinct("w").alias("words")))
    each = texts.select(lexemes(F.col(text), config).alias("w")).select(F.explode(lists).alias("x")).select("x.once", F.explode("x.words").alias("word"))
    return each.groupBy("word").agg(F.count_if("once").alias("ndoc"), F.count_if(~F.col("once")).alias("nentry"))
