"""Search for the terms of a dictionary in texts by joins on tokens (J5, and the ground of X5 and X9).

Texts and terms are cut into the same tokens: runs of letters, runs of digits, runs of white space, and every other
character by itself; compared without case and accents. A term that begins and ends at borders of letters and digits
is a run of whole tokens. The dictionary is a table: each first token of a key's terms has the numbers of tokens that
terms beginning with it have. A text's tokens meet these first tokens, and only from the places where one begins the
token runs of those lengths meet the whole terms. So no pattern grows with the dictionary, and many terms with one first
token cost no more than a few lengths. Keys of both joins are unique on the side of the dictionary, which is repeated for
a few salts, so a token or term that a third of all texts hold is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _BARE, _MARKED, let, plain, value_key
from ..tables import merged_in

#: Shares that a frequent token or term is dealt into.
SALTS = 8
#: Bytes of a dictionary that goes to the tasks as a whole (``in_row``).
MOST_IN_ROW = 64 << 20
#: Buckets that such a dictionary is put together from at a time.
_PAGE = 1024
_TOKEN = r"\p{L}[\p{L}\p{M}]*|\p{N}+|\s+|(?s:.)"
_FROM, _TO = _MARKED + _MARKED.upper() + "ſıİK", _BARE + _BARE.upper() + "siik"


def folded(token: Column) -> Column:
    """A token as it is compared: white space is one space, letters have neither case nor accents."""
    plain = F.regexp_replace(F.lower(F.translate(token, _FROM, _TO)), r"\p{M}", "")
    return F.when(token.rlike(r"^\s"), F.lit(" ")).otherwise(plain)


def tokens(text: Column, protected: str | None = None) -> Column:
    """The tokens of a text; joined they are the text. Matches of ``protected`` are tokens of their own."""
    return F.regexp_extract_all(text, F.lit(f"{protected}|{_TOKEN}" if protected else _TOKEN), F.lit(0))


def compared(raw: Column, protected: str | None = None) -> Column:
    """Tokens as they are compared; protected ones equal no token of a term."""
    fold = lambda t: folded(t) if protected is None else F.when(t.rlike(f"^(?:{protected})$"), F.lit("")).otherwise(folded(t))
    return F.transform(raw, fold)


def compared_text(text: Column, protected: str | None = None) -> Column:
    """``compared`` of the tokens of a text that is not null.

    A text is folded as a whole before it is cut, which gives the same tokens but where a protected match, a combining
    mark, or a Greek capital whose small letter depends on its neighbours is in it: only there tokens are folded one by one.
    """
    def cut(bare: Column) -> Column:
        apart = text.contains("Σ") | bare.rlike(r"\p{M}")
        if protected is not None:
            apart = apart | text.rlike(protected)
        return F.when(apart, compared(tokens(text, protected), protected)).otherwise(tokens(bare))

    return let(F.regexp_replace(F.lower(F.translate(text, _FROM, _TO)), r"\s+", " "), cut)


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def candidates(texts: DataFrame, terms: DataFrame, key: str, value: str = "value", protected: str | None = None, apart: bool = False) -> DataFrame:
    """Every place of every term: the key, text_id, ``pos`` (token, from 0), ``n`` (tokens) and the columns of ``terms``.

    ``texts`` has the key, text_id and text; ``terms`` the key and ``value``, and may have more columns. Terms of other
    keys are not looked for; terms without a token are none. Overlapping places are all there. With ``apart`` neither a
    letter nor a digit stands beside a place.
    """
    listed = terms.withColumn("__t", compared(tokens(value_key(F.col(value))))).where(F.size("__t") > 0)
    listed = listed.withColumns({"n": F.size("__t"), "__h": F.xxhash64("__t")})
    first = listed.groupBy(key, F.col("__t")[0].alias("__first")).agg(F.sort_array(F.collect_set("n")).alias("__n"))
    salt = F.pmod(F.xxhash64("text_id"), F.lit(SALTS)).cast("int").alias("__salt")
    cut = texts.where("text is not null").select(key, "text_id", compared_text(F.col("text"), protected).alias("__w"))
    held = cut.select(key, "text_id", F.explode(F.array_distinct("__w")).alias("__first"), salt)
    met = held.join(merged_in(_salted(first)), [key, "__first", "__salt"]).groupBy(key, "text_id").agg(F.map_from_entries(F.collect_list(F.struct("__first", "__n"))).alias("__met"))
    begun = cut.join(merged_in(met), [key, "text_id"]).select(key, "text_id", "__w", "__met", F.posexplode("__w").alias("pos", "__first"))
    begun = begun.withColumn("n", F.explode(F.element_at("__met", F.col("__first")))).where("pos + n <= size(__w)")
    if apart:
        alone = lambda i: ~F.coalesce(F.get("__w", i), F.lit(" ")).rlike(r"^[\p{L}\p{N}]")
        begun = begun.where((F.col("pos") == 0) | alone(F.col("pos") - 1)).where(alone(F.col("pos") + F.col("n")))
    runs = begun.select(key, "text_id", "pos", F.slice("__w", F.col("pos") + 1, F.col("n")).alias("__r"), salt)
    runs = runs.withColumn("__h", F.xxhash64("__r"))
    found = runs.join(merged_in(_salted(listed)), [key, "__h", "__salt"]).where("__r = __t")
    return found.drop("__r", "__t", "__h", "__salt")


def in_row(terms: DataFrame, key: str, value: str = "value") -> tuple[Column, Callable[[Column, Column, Column, Column, str | None], Column]] | None:
    """``candidates`` without joins: a dictionary, and a function of it, a row's key, text, tokens and ``protected`` that gives the places in the row, by ``pos``.

    Texts neither move nor meet rows of tokens, which take many times a text's bytes. The terms are one value of a subquery: an
    array of buckets by the hash of key and term, so a token costs a look into one bucket. A bucket also says which lengths longer
    terms that begin with a token have. ``terms`` is read three times. None for a dictionary above ``MOST_IN_ROW``.

    The dictionary has to be a column of its own on top of no other projection, taken by the function once and then dropped: the
    optimiser puts it in its place, so it is in no row (``with_dictionary``).
    """
    kept = [c for c in terms.columns if c != key]
    listed = terms.withColumn("__t", compared(tokens(value_key(F.col(value))))).where((F.size("__t") > 0) & F.col(key).isNotNull())
    # Beside its texts a term takes some 160 bytes in the array.
    weights = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in terms.columns), F.lit(160) + F.octet_length(F.array_join("__t", "")))
    n, size, longest, shortest = listed.agg(F.count("*"), F.sum(weights), F.max(F.size("__t")), F.min(F.length(F.col("__t")[0]))).first()
    if n and size > MOST_IN_ROW:
        return None
    buckets, single = max(4 * n, 1), (longest or 1) == 1
    item = F.struct(*kept)
    place = lambda k, run: F.pmod(F.xxhash64(k, run), F.lit(buckets)).cast("int")
    bucket = lambda d, b: let(b, lambda b: F.get(F.get(d, F.shiftright(b, _PAGE.bit_length() - 1)), b.bitwiseAND(_PAGE - 1)))
    rows = listed.select(F.col(key).alias("k"), F.col("__t").alias("t"), F.lit(None).cast("array<int>").alias("ns"), item.alias("x"))
    shape = rows.schema["x"].dataType
    if not single:
        begun = listed.where("size(__t) > 1").groupBy(F.col(key).alias("k"), F.array(F.col("__t")[0]).alias("t")).agg(F.sort_array(F.collect_set(F.size("__t"))).alias("ns"))
        rows = rows.unionByName(begun.withColumn("x", F.lit(None).cast(shape)))
    # A term of one token is placed by its token, so that a text's tokens need not be made arrays.
    rows = rows.withColumn("b", F.when(F.size("t") == 1, place(F.col("k"), F.col("t")[0])).otherwise(place(F.col("k"), F.col("t"))))
    filled = rows.groupBy("b").agg(F.collect_list(F.struct("k", "t", "ns", "x")).alias("own"))
    dense = terms.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(filled, "b", "left")
    in_order = lambda at, c: F.transform(F.sort_array(F.collect_list(F.struct(at, c))), lambda r: r[c])
    pages = dense.groupBy(F.floor(F.col("b") / _PAGE).alias("p")).agg(in_order("b", "own").alias("page"))
    table = pages.agg(in_order("p", "page")).scalar()
    none = F.array().cast(f"array<struct<pos:int,n:int,{shape.simpleString()[7:]}>")

    def looked(d: Column, k: Column, w: Column) -> Column:
        hit = lambda x, pos, n: F.struct(pos.alias("pos"), n.alias("n"), *[x[c].alias(c) for c in kept])

        def longer(at: Column, pos: Column) -> Column:
            tried = F.filter(F.flatten(F.transform(F.filter(at, lambda e: e["ns"].isNotNull()), lambda e: e["ns"])), lambda n: pos + n <= F.size(w))
            met = lambda run: F.filter(bucket(d, place(k, run)), lambda e: (e["k"] == k) & (e["t"] == run) & e["x"].isNotNull())
            return F.flatten(F.transform(tried, lambda n: let(F.slice(w, pos + 1, n), lambda run: F.coalesce(F.transform(met(run), lambda e: hit(e["x"], pos, n)), none))))

        def begun(t: Column, pos: Column) -> Column:
            own = F.filter(bucket(d, place(k, t)), lambda e: (F.get(e["t"], F.lit(0)) == t) & (e["k"] == k) & (F.size(e["t"]) == 1))
            ones = lambda at: F.transform(at, lambda e: hit(e["x"], pos, F.lit(1)))
            return ones(own) if single else let(own, lambda at: F.concat(ones(F.filter(at, lambda e: e["x"].isNotNull())), longer(at, pos)))

        # Folding makes no token longer. With terms of one token only, white space and protected tokens equal none however they are folded.
        folding = lambda t: F.when(plain(t), F.lower(t)).otherwise(F.regexp_replace(F.lower(F.translate(t, _FROM, _TO)), r"\p{M}", ""))
        begins = lambda t, pos: F.when(F.length(t) >= (shortest or 0), let(folding(t), lambda f: begun(f, pos)) if single else begun(t, pos))
        return F.flatten(F.filter(F.transform(w, begins), lambda x: x.isNotNull()))

    def found(table: Column, k: Column, text: Column, cut: Column, protected: str | None = None) -> Column:
        return let(table, lambda d: looked(d, k, cut) if single else let(compared_text(text, protected), lambda w: looked(d, k, w)))

    return table, found


def with_dictionary(df: DataFrame, table: Column, name: str, made: Column) -> DataFrame:
    """``df`` and the column ``made`` of it and of the dictionary, which it names ``__d``.

    The rows come through a generator of one row each, so that no other projection is below the dictionary's, and its array is
    in the expression, not in the rows.
    """
    last = df.columns[-1]
    rows = df.select(*df.columns[:-1], F.explode(F.array(last)).alias(last))
    return rows.withColumn("__d", table).withColumn(name, made).drop("__d")


def resolved_in_row(found: Column, prefer: str = "leftmost", length: str = "n") -> Column:
    """``resolved`` for the places of one text, by ``pos``."""
    if prefer not in ("leftmost", "longest"):
        raise ValueError("prefer is leftmost or longest")
    order = (lambda x: F.struct(x["pos"], -x[length], x["rank"])) if prefer == "leftmost" else (lambda x: F.struct(-x[length], x["rank"], x["pos"]))
    meet = lambda x, y: (y["pos"] < x["pos"] + x["n"]) & (x["pos"] < y["pos"] + y["n"])

    def sort(xs: Column) -> Column:
        return F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(order(x).alias("o"), x.alias("x")))), lambda p: p["x"])

    def chosen(xs: Column) -> Column:
        """Of places that overlap those that stay, one after the other."""
        none = F.filter(xs, lambda x: F.lit(False))
        if prefer == "leftmost":
            clash = lambda out, x: F.coalesce(F.try_element_at(out, F.lit(-1))["pos"] + F.try_element_at(out, F.lit(-1))["n"] > x["pos"], F.lit(False))
        else:
            clash = lambda out, x: F.exists(out, lambda y: meet(x, y))
        return F.aggregate(sort(xs), none, lambda out, x: F.when(clash(out, x), out).otherwise(F.concat(out, F.array(x))))

    def runs(xs: Column) -> Column:
        """Places put together by runs of overlapping ones."""
        begin = F.struct(F.array(none_of(xs)).alias("all"), F.lit(0).alias("reach"))

        def step(acc: Column, x: Column) -> Column:
            last = F.element_at(acc["all"], -1)
            joined = F.concat(F.slice(acc["all"], F.lit(1), F.size(acc["all"]) - 1), F.array(F.concat(last, F.array(x))))
            return F.struct(F.when(x["pos"] >= acc["reach"], F.concat(acc["all"], F.array(F.array(x)))).otherwise(joined).alias("all"), F.greatest(acc["reach"], x["pos"] + x["n"]).alias("reach"))

        return F.aggregate(xs, begin, step)["all"]

    none_of = lambda xs: F.filter(xs, lambda x: F.lit(False))
    apart = lambda xs: F.forall(F.transform(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["pos"] + F.get(xs, i - 1)["n"] <= x["pos"])), lambda b: b)
    long = lambda xs: F.flatten(F.transform(runs(xs), lambda r: F.when(F.size(r) < 2, r).otherwise(chosen(r))))
    return let(found, lambda xs: F.when(apart(xs), xs).otherwise(long(xs)))


def resolved(found: DataFrame, key: str, prefer: str = "leftmost", length: str = "n") -> DataFrame:
    """Candidates that do not overlap: ``leftmost`` (of equal places the longest first) or ``longest`` (wherever it is).

    Only candidates that overlap others are put together, by runs of overlapping ones; the rest stays as it is.
    ``length`` is the column that says how long a term is; ties go to the smaller value of ``rank``.
    """
    if prefer not in ("leftmost", "longest"):
        raise ValueError("prefer is leftmost or longest")
    by_place = Window.partitionBy(key, "text_id").orderBy("pos")
    place = Window.partitionBy(key, "text_id", "pos").orderBy(F.desc(length), "rank")
    rows = found if prefer == "longest" else found.withColumn("__r", F.row_number().over(place)).where("__r = 1").drop("__r")
    reach = F.max(F.col("pos") + F.col("n")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.coalesce(F.col("pos") >= reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    kept = [c for c in found.columns if c not in (key, "text_id")]
    order = F.struct("pos") if prefer == "leftmost" else F.struct((-F.col(length)).alias("l"), "rank", "pos")
    item = F.struct(order.alias("__o"), *kept)
    runs = rows.groupBy(key, "text_id", "__run").agg(F.sort_array(F.collect_list(item)).alias("__all"))
    shape = runs.schema["__all"].dataType

    def take(out: Column, x: Column) -> Column:
        taken = F.exists(out, lambda y: (y["pos"] < x["pos"] + x["n"]) & (x["pos"] < y["pos"] + y["n"]))
        return F.when(taken, out).otherwise(F.concat(out, F.array(x)))

    def last(out: Column, x: Column) -> Column:
        end = F.try_element_at(out, F.lit(-1))
        return F.when((F.size(out) > 0) & (end["pos"] + end["n"] > x["pos"]), out).otherwise(F.concat(out, F.array(x)))

    chosen = F.when(F.size("__all") == 1, F.col("__all")).otherwise(F.aggregate("__all", F.array().cast(shape), last if prefer == "leftmost" else take))
    return runs.select(key, "text_id", F.explode(chosen).alias("__x")).select(key, "text_id", *[F.col(f"__x.{c}") for c in kept])


def with_offsets(matches: DataFrame, texts: DataFrame, key: str, protected: str | None = None) -> DataFrame:
    """Matches that do not overlap, with ``start`` and ``end`` in their text and what stands there (``found``)."""
    kept = [c for c in matches.columns if c not in (key, "text_id")]
    own = matches.groupBy(key, "text_id").agg(F.sort_array(F.collect_list(F.struct("pos", *[c for c in kept if c != "pos"]))).alias("__m"))
    rows = texts.join(merged_in(own), [key, "text_id"]).withColumn("__w", tokens(F.col("text"), protected))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("__m", i - 1)["pos"] + F.get("__m", i - 1)["n"])
    joined = lambda a, n: F.array_join(F.slice("__w", a + 1, n), "")
    each = F.transform("__m", lambda m, i: F.struct(m.alias("m"), F.length(joined(before(i), m["pos"] - before(i))).alias("gap"), joined(m["pos"], m["n"]).alias("found")))
    rows = rows.select(key, "text_id", F.posexplode(each).alias("__i", "__x"))
    order = Window.partitionBy(key, "text_id").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("__x.gap") + F.length("__x.found")).over(order).cast("int")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("__x.found"))
    return rows.select(key, "text_id", "start", "end", F.col("__x.found").alias("found"), *[F.col(f"__x.m.{c}") for c in kept])
