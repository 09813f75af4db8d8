"""Variant spellings of the names of persons and organisations.

1. Names become tokens; the distinct tokens of the corpus are joined with each other by a
   prefix-filtered set-similarity join on q-grams (rarest q-grams first, within one letter of
   length), as typed and as they sound. Pairs one edit apart are near; the join finds all of them.
   Each token has a best supported spelling near it, and options: the near ones that stand for themselves.
2. A token's place in names tells which token of a name is the family name or brand. Short forms
   of given names come from a given list and from names that state both ("X alias Y", "X @ Y");
   initials and short forms are settled among the given names that occur with the same family
   name. Abbreviated lines of business are settled among the lines that occur.
3. Representatives are the pairs of settled tokens that occur. A name's candidates are the
   representatives near it in both tokens; each is verified by soft weighted token similarity, where
   rare tokens count more, and the most similar one of at least ``min_score`` is the name's.
4. Rows with one representative are one entity; pairs are formed only inside these groups.

Vocabularies grow far slower than rows, and a name meets few representatives: a family name that a third
of all rows share is one token, and no pairs of names are formed within it.

Defined results: rows without id, name or a type that reads as person or organisation give
nothing; letter case, punctuation, titles, legal forms and middle initials do not count. An
initial that fits several given names of the family, and a short form that does likewise, link
nothing, nor does a person's name of one word. Tokens of one to three letters have no variants. A token of
more than three rows only moves to one ten times as frequent. Repeated rows count once; an id with several
names joins the groups of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.plans.lineage import Scratch

#: Spellings of the two kinds (fixed values).
PERSON_TYPES = ("person", "per", "individual")
ORGANISATION_TYPES = ("organization", "organisation", "org", "company")
TITLES = "mr mrs ms miss dr prof shri sri smt kum sir er adv"
LEGAL = (
    "ltd limited pvt private llp llc inc incorporated corp corporation plc co-op sons sns son bros brothers "
    "enterprises enterprise entp entps and the messrs"
)
Q = 3
SALTS = 8
SHORT = 6  # letters up to which tokens are also joined by their deletions
PREFIX = 5  # one transposition touches at most q + 1 of the padded q-grams: prefix q + 2


def kind_of(type_col: str | Column) -> Column:
    t = F.lower(F.trim(F.col(type_col) if isinstance(type_col, str) else type_col))
    return F.when(t.isin(*PERSON_TYPES), "person").when(t.isin(*ORGANISATION_TYPES), "organisation")


def sound(c: Column) -> Column:
    """A spelling key that maps common alternative spellings of one sound together."""
    for pattern, by in (("ee", "i"), ("oo", "u"), ("ou", "u"), ("w", "v"), ("ph", "f"), ("ck", "k"), ("c(?!h)", "k"), ("x", "ks"), (r"(\p{L})\1+", "$1")):
        c = F.regexp_replace(c, pattern, by)
    return c


def one_edit(a: str, b: str) -> Column:
    """Whether two texts are at most one insertion, deletion, replacement or swap of neighbours apart."""
    swapped = f"exists(sequence(1, length({a}) - 1), i -> concat(left({a}, i - 1), substr({a}, i + 1, 1), substr({a}, i, 1), substr({a}, i + 2)) = {b})"
    return F.expr(f"levenshtein({a}, {b}, 2) in (0, 1) or (length({a}) = length({b}) and length({a}) > 1 and levenshtein({a}, {b}, 2) = 2 and {swapped})")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{M}\p{Nd}]+", " "), " "), lambda x: x != "")


def parse(rows: DataFrame) -> DataFrame:
    """``rows`` (kind, name) distinct; adds tokens (in order given-family or as written) and nicks."""
    n = F.trim(F.regexp_replace(F.lower("name"), r"\s+", " "))
    titles = "|".join(TITLES.split())
    person = F.regexp_replace(n, rf"^((?:{titles})\.? )+", "")
    also = r" (?:alias|aka|a\.k\.a\.?|urf) "
    main = F.when(person.rlike(also), F.regexp_replace(person, rf"^.*?{also}", "")).otherwise(F.regexp_replace(person, r" ?@.*$", ""))
    nick = F.when(person.rlike(also), F.regexp_replace(person, rf"{also}.*$", "")).when(
        person.contains("@"), F.regexp_replace(person, r"^.*@ ?", "")
    )
    comma = F.regexp_replace(main, r"^([^,]*\S) ?, ?(\S[^,]*)$", "$2 $1")
    legal = F.array(*[F.lit(x) for x in LEGAL.split()])
    org = F.regexp_replace(F.regexp_replace(n, r"^(?:m/s\.?|messrs\.?|the) +", ""), r"[.']", " ")
    org_words = F.filter(_words(org), lambda x: (F.length(x) > 1) & ~F.array_contains(legal, x))
    return rows.select(
        "kind",
        "name",
        F.when(F.col("kind") == "person", _words(comma)).otherwise(org_words).alias("tokens"),
        F.when(F.col("kind") == "person", F.element_at(_words(nick), 1)).alias("nick"),
    ).where(F.size("tokens") > 0)


def similar_tokens(vocab: DataFrame) -> DataFrame:
    """(kind, a, b): pairs of different tokens of ``vocab`` (kind, token, key) whose keys are one edit apart."""
    grams = vocab.select(
        "kind", "token", "key", F.explode(F.expr(f"array_distinct(transform(sequence(0, length(key) + 1), i -> substr(concat('^^', key, '$$'), i + 1, {Q})))")).alias("g")
    )
    df = grams.groupBy("kind", "g").agg(F.count("*").alias("n"))
    rank = W.partitionBy("kind", "token").orderBy("n", "g")
    prefix = (
        grams.join(df, ["kind", "g"])
        .withColumn("r", F.row_number().over(rank))
        .where(F.col("r") <= PREFIX)
        .select("kind", "g", "token", "key", F.length("key").alias("len"))
    )
    left = prefix.select("kind", "g", F.col("token").alias("a"), F.col("key").alias("ka"), F.explode(F.expr("array(len - 1, len, len + 1)")).alias("len"))
    right = prefix.select("kind", "g", F.col("token").alias("b"), F.col("key").alias("kb"), "len")
    pairs = left.join(right, ["kind", "g", "len"]).where("a < b").select("kind", "a", "ka", "b", "kb")
    # short tokens may share no q-gram with a neighbour, but one edit apart they share a deletion
    cut = F.expr("array_distinct(concat(array(key), transform(sequence(1, length(key)), i -> concat(left(key, i - 1), substr(key, i + 1)))))")
    short = vocab.where(f"length(key) between 1 and {SHORT}").select("kind", "token", "key", F.explode(cut).alias("g"))
    brief = short.select("kind", "g", F.col("token").alias("a"), F.col("key").alias("ka")).join(short.select("kind", "g", F.col("token").alias("b"), F.col("key").alias("kb")), ["kind", "g"])
    pairs = pairs.unionByName(brief.where("a < b").select("kind", "a", "ka", "b", "kb")).distinct()
    return pairs.where(one_edit("ka", "kb")).select("kind", "a", "b")


def spellings(tokens: DataFrame, protected: DataFrame, scratch: Scratch, least_length: int = 4) -> tuple[DataFrame, DataFrame]:
    """(kind, token, canon, n_canon, first_share): the best supported spelling near each token; and
    (kind, token, option): all near spellings that stand for themselves.

    ``tokens`` has (kind, token, first) for every token of every row, ``protected`` the (token)
    that stay as they are. A token moves to a neighbour at least ten times as frequent, or to any
    better ranked one while it is itself rare.
    """
    vocab = scratch.cut(
        tokens.groupBy("kind", "token")
        .agg(F.count("*").alias("n"), F.count_if("first").alias("n_first"), F.count("first").alias("n_place"))
    )
    long = vocab.where(F.length("token") >= least_length)
    as_typed = similar_tokens(long.select("kind", "token", F.col("token").alias("key")))
    as_heard = similar_tokens(long.select("kind", "token", sound(F.col("token")).alias("key")))
    near = scratch.cut(as_typed.unionByName(as_heard).distinct())
    both = near.unionByName(near.select("kind", F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("kind", F.col("a").alias("token")).agg(F.count("*").alias("deg"))
    ranked = vocab.join(degree, ["kind", "token"], "left").select("kind", "token", "n", F.coalesce("deg", F.lit(0)).alias("deg"))
    better = (
        both.join(ranked.select("kind", F.col("token").alias("a"), F.col("n").alias("na"), F.col("deg").alias("da")), ["kind", "a"])
        .join(ranked.select("kind", F.col("token").alias("b"), F.col("n").alias("nb"), F.col("deg").alias("db")), ["kind", "b"])
        .where("na <= greatest(3, 0.1D * nb) and (nb > na or (nb = na and (db > da or (db = da and b < a))))")
        .join(protected.select(F.col("token").alias("a")), "a", "left_anti")
        .groupBy("kind", "a")
        .agg(F.max_by("b", F.struct("nb", "db", "b")).alias("up"))
    )
    hop = scratch.cut(vocab.join(better.withColumnRenamed("a", "token"), ["kind", "token"], "left").select("kind", "token", F.coalesce("up", "token").alias("up")))
    while True:  # a variant of a variant; ranks rise along a chain, so this ends
        above = hop.select("kind", F.col("token").alias("up"), F.col("up").alias("top"))
        on = scratch.cut(hop.join(above, ["kind", "up"], "left").select("kind", "token", F.coalesce("top", "up").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        scratch.drop(hop)
        hop = on.drop("moved")
        if on.where("moved").isEmpty():
            break
    canon = vocab.join(hop, ["kind", "token"]).select("kind", "token", F.col("up").alias("canon"), "n", "n_first", "n_place")
    total = canon.groupBy("kind", "canon").agg(
        F.sum("n").alias("n_canon"), ((F.sum("n_first") + 1) / (F.sum("n_place") + 2)).alias("first_share")
    )
    settled = hop.where("token = up").select("kind", F.col("token").alias("b"))
    options = both.join(settled, ["kind", "b"]).select("kind", F.col("a").alias("token"), F.col("b").alias("option")).unionByName(hop.withColumnRenamed("up", "option")).distinct()
    return scratch.cut(canon.join(total, ["kind", "canon"]).select("kind", "token", "canon", "n_canon", "first_share")), scratch.cut(options)


def alike(a: str, b: str) -> Column:
    """Similarity of two tokens: one less the edits (a swap of neighbours is one) over the longer length, of the texts or, a little less, of their sounds."""
    edits = lambda x, y: 1 - F.when(F.col(x) == F.col(y), 0).when(one_edit(x, y), 1).otherwise(F.levenshtein(x, y)) / F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.greatest(edits(a, b), edits(f"_s_{a}", f"_s_{b}") - 0.05)


def with_sounds(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({f"_s_{c}": sound(F.col(c)) for c in columns})


def short_forms(parsed: DataFrame, canon: DataFrame, aliases: DataFrame, share: float = 0.2) -> DataFrame:
    """(short, full): the given list, and what names that state both forms say often enough."""
    listed = aliases.select(F.lower(F.trim("short_name")).alias("short"), F.lower(F.trim("given_name")).alias("full")).where("short is not null and full is not null").distinct()
    c = canon.where("kind = 'person'").select("token", "canon", "first_share")
    stated = (
        parsed.where("kind = 'person' and nick is not null and size(tokens) >= 2")
        .select(F.col("nick").alias("token"), F.explode("tokens").alias("other"))
        .join(c.select("token", F.col("canon").alias("short")), "token")
        .join(c.select(F.col("token").alias("other"), F.col("canon").alias("full"), F.col("first_share")), "other")
        .where("first_share > 0.5 and length(full) > 1 and length(short) > 1")
        .groupBy("short", "full")
        .agg(F.count("*").alias("n"))
        .withColumn("all", F.sum("n").over(W.partitionBy("short")))
        .where(f"n >= {share} * all and n >= 2 and short <> full")
    )
    # what is itself a short form leads on to its own full form
    known = stated.select("short", "full").join(listed.select("short"), "short", "left_anti")
    further = known.join(listed.select(F.col("short").alias("full"), F.col("full").alias("top")), "full", "left")
    return listed.unionByName(further.select("short", F.coalesce("top", "full").alias("full"))).distinct()


def person_keys(parsed: DataFrame, canon: DataFrame, options: DataFrame, shorts: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, group, score) of the persons' names that could be settled."""
    c = canon.where("kind = 'person'").drop("kind")
    n_all = F.lit(float(max(1, c.count())))
    toks = parsed.where("kind = 'person'").select("name", F.posexplode("tokens").alias("pos", "token"))
    toks = toks.join(c, "token", "left").withColumn("initial", F.length("token") == 1)
    word = F.struct((-F.col("first_share")).alias("s"), "pos", "token", "canon", "n_canon")
    per = (
        toks.groupBy("name")
        .agg(F.array_sort(F.collect_list(F.when(~F.col("initial"), word))).alias("w"), F.min_by("token", F.struct(~F.col("initial"), F.col("pos"))).alias("i0"))
        .withColumn("family", F.when(F.size("w") >= 1, F.element_at("w", -1)))
        .withColumn("given", F.when(F.size("w") >= 2, F.element_at("w", 1)))
        .where("family is not null and (given is not null or length(i0) = 1)")
    )
    typed = scratch.cut(
        per.select(
            "name",
            F.col("family.canon").alias("fam"),
            F.col("family.token").alias("fam_raw"),
            F.col("family.n_canon").alias("fam_n"),
            F.coalesce("given.canon", "i0").alias("giv"),
            F.coalesce("given.token", "i0").alias("giv_raw"),
            F.coalesce("given.n_canon", F.lit(1)).alias("giv_n"),
        )
    )
    # settle short forms: by the only full form, or by the only one in this family
    full = typed.where("length(giv) > 2").join(shorts.select(F.col("short").alias("giv")).distinct(), "giv", "left_anti").select("fam", F.col("giv").alias("full")).distinct()
    n_full = shorts.groupBy("short").agg(F.count("*").alias("ways"), F.first("full").alias("only"))
    nick = typed.select("fam", "giv").distinct().join(n_full, F.col("giv") == F.col("short"))
    here = (
        nick.join(shorts, "short").join(full, ["fam", "full"]).groupBy("fam", "giv").agg(F.count("*").alias("n"), F.min("full").alias("in_family"))
    )
    settled = nick.join(here, ["fam", "giv"], "left").select(
        "fam", "giv", F.when(F.col("n") == 1, F.col("in_family")).when(F.col("n") > 1, F.lit("?")).when(F.col("ways") == 1, F.col("only")).otherwise(F.concat(F.lit("~"), "giv")).alias("to")
    )
    named = scratch.cut(typed.join(settled, ["fam", "giv"], "left").withColumn("g", F.coalesce("to", "giv")).drop("to"))
    # settle initials and other abbreviations of one or two letters among the family's given names
    givens = named.where("length(g) > 2 and g not like '~%'").select("fam", F.col("g").alias("cand")).distinct()
    brief = named.where("length(g) <= 2 and g <> '?'").select("fam", F.col("g").alias("b")).distinct()
    fits = brief.withColumn("c1", F.left("b", F.lit(1))).join(givens.withColumn("c1", F.left("cand", F.lit(1))), ["fam", "c1"])
    fits = fits.where("length(b) = 1 or (instr(substr(cand, 2), substr(b, 2)) > 0)").groupBy("fam", "b").agg(F.count("*").alias("n"), F.min("cand").alias("cand"))
    done = named.join(fits.withColumnRenamed("b", "g"), ["fam", "g"], "left").withColumn(
        "gg", F.when(F.col("n") == 1, F.col("cand")).when(F.col("n") > 1, F.lit("?")).otherwise(F.col("g"))
    )
    done = scratch.cut(done.where("gg <> '?'").select("name", "fam_raw", "giv_raw", "fam", "gg", "fam_n", "giv_n", (F.col("gg") == F.col("giv")).alias("as_typed")))
    # representatives, and the names that may mean one of them: near in both tokens
    reps = done.join(counts.where("kind = 'person'"), "name").groupBy("fam", "gg").agg(F.sum("n").alias("support"))
    near = options.where("kind = 'person'").select("token", "option")
    fams, givs = near.toDF("fam_raw", "f2"), near.toDF("giv_raw", "g2")
    plain = F.col("as_typed") & (F.length("gg") > 1)
    pairs = done.where(plain).join(givs, "giv_raw").unionByName(done.where(~plain).withColumn("g2", F.col("gg"))).join(fams, "fam_raw")
    pairs = pairs.join(reps.select(F.col("fam").alias("f2"), F.col("gg").alias("g2"), "support"), ["f2", "g2"])
    pairs = with_sounds(pairs, "fam_raw", "f2", "giv_raw", "g2")
    w1, w2 = F.log(1 + n_all / F.col("fam_n")), F.log(1 + n_all / F.col("giv_n"))
    given = F.when(~F.col("as_typed"), 0.85).otherwise(alike("giv_raw", "g2"))
    score = F.round((w1 * alike("fam_raw", "f2") + w2 * given) / (w1 + w2), 6)
    return best(pairs.select("name", F.concat_ws("|", F.lit("p"), "f2", "g2").alias("group"), score.alias("score"), "support"))


def best(scored: DataFrame) -> DataFrame:
    """(name, group, score): each name's most similar representative; of equal ones the better supported, then the first."""
    top = F.max_by(F.struct("group", "score"), F.struct(F.col("score"), F.col("support"), F.col("group")))
    return scored.groupBy("name").agg(top.alias("t")).select("name", "t.*")


def organisation_keys(parsed: DataFrame, canon: DataFrame, options: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, group, score) of the organisations' names."""
    c = canon.where("kind = 'organisation'").drop("kind")
    n_all = F.lit(float(max(1, c.count())))
    toks = parsed.where("kind = 'organisation'").select("name", F.posexplode("tokens").alias("pos", "token")).join(c, "token", "left")
    word = F.struct("pos", "token", "canon", "n_canon", "first_share")
    per = toks.groupBy("name").agg(F.array_sort(F.collect_list(word)).alias("w"), F.max_by(word, F.struct("first_share", -F.col("pos"))).alias("brand"))
    typed = scratch.cut(
        per.select(
            "name",
            F.col("brand.canon").alias("brand"),
            F.col("brand.token").alias("brand_raw"),
            F.col("brand.n_canon").alias("brand_n"),
            F.expr("array_join(transform(filter(w, x -> x.pos <> brand.pos), x -> x.canon), ' ')").alias("line"),
            F.expr("array_join(transform(filter(w, x -> x.pos <> brand.pos), x -> x.token), ' ')").alias("line_raw"),
            F.aggregate(F.expr("filter(w, x -> x.pos <> brand.pos)"), F.lit(0.0), lambda acc, x: acc + F.log(1 + n_all / x.n_canon)).alias("line_weight"),
        )
    )
    # abbreviated lines: the most frequent line with the same initials that they abbreviate
    lines = typed.groupBy("line").agg(F.count("*").alias("n")).withColumn("sig", F.expr("array_join(transform(split(line, ' '), x -> left(x, 1)), '')"))
    lines = scratch.cut(lines)
    pattern = F.expr("concat('^', array_join(transform(split(a, ' '), x -> concat(array_join(split(x, ''), '[a-z]*'), '[a-z]*')), ' '), '$')")
    salt = F.pmod(F.hash("line"), F.lit(SALTS))  # common initials are many lines
    longer = (
        lines.select(F.col("line").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        .join(lines.select(F.col("line").alias("b"), F.col("n").alias("nb"), "sig", salt.alias("salt")), ["sig", "salt"])
        .where("nb > na and length(b) > length(a) and a <> ''")
        .where(F.call_function("rlike", F.col("b"), pattern))
        .groupBy("a")
        .agg(F.max_by("b", F.struct("nb", "b")).alias("line_full"))
    )
    done = scratch.cut(typed.join(longer.withColumnRenamed("a", "line"), "line", "left").withColumn("to", F.coalesce("line_full", "line")).drop("line_full"))
    reps = done.join(counts.where("kind = 'organisation'"), "name").groupBy("brand", "to").agg(F.sum("n").alias("support"))
    near = options.where("kind = 'organisation'").select(F.col("token").alias("brand_raw"), F.col("option").alias("b2"))
    pairs = done.select("name", "brand_raw", "brand_n", "line", "line_raw", "line_weight", "to").join(near, "brand_raw")
    pairs = with_sounds(pairs.join(reps.select(F.col("brand").alias("b2"), "to", "support"), ["b2", "to"]), "brand_raw", "b2", "line_raw", "to")
    w1 = F.log(1 + n_all / F.col("brand_n"))
    of_line = F.when(F.col("line") != F.col("to"), 0.85).otherwise(alike("line_raw", "to"))
    score = F.round((w1 * alike("brand_raw", "b2") + F.col("line_weight") * of_line) / (w1 + F.col("line_weight")), 6)
    return best(pairs.select("name", F.concat_ws("|", F.lit("o"), "b2", "to").alias("group"), score.alias("score"), "support"))


def link_names(entities: DataFrame, aliases: DataFrame, *, entity_id: str = "entity_id", name: str = "name", type_: str = "type", min_score: float = 0.6) -> DataFrame:
    """(entity_id, kind, name, group_id): rows of one group mean the same person or organisation."""
    scratch = Scratch(entities.sparkSession, "names")
    rows = scratch.cut(
        entities.select(F.col(entity_id).alias("entity_id"), kind_of(type_).alias("kind"), F.col(name).alias("name"))
        .where("entity_id is not null and kind is not null and trim(name) <> ''")
        .distinct()
    )
    parsed = parse(rows.select("kind", "name").distinct())
    parsed = scratch.cut(parsed)
    counts = rows.groupBy("kind", "name").agg(F.count("*").alias("n"))
    words = F.filter("tokens", lambda x: F.length(x) > 1)
    main = rows.join(parsed, ["kind", "name"]).select("kind", F.posexplode(words).alias("pos", "token"), F.size(words).alias("of"))
    tokens = main.select("kind", "token", F.when(F.col("of") > 1, F.col("pos") == 0).alias("first"))
    nicks = rows.join(parsed, ["kind", "name"]).where("length(nick) > 1").select("kind", F.col("nick").alias("token"), F.lit(None).cast("boolean").alias("first"))
    listed = aliases.select(F.explode(F.array(F.lower(F.trim("short_name")), F.lower(F.trim("given_name")))).alias("token")).where("token is not null").distinct()
    canon, options = spellings(tokens.unionByName(nicks), listed, scratch)
    shorts = scratch.cut(short_forms(parsed, canon, aliases))
    keys = person_keys(parsed, canon, options, shorts, counts, scratch).withColumn("kind", F.lit("person")).unionByName(
        organisation_keys(parsed, canon, options, counts, scratch).withColumn("kind", F.lit("organisation"))
    )
    keys = keys.where(F.col("score") >= min_score).select("kind", "name", F.col("group").alias("group_id"))
    return rows.join(keys, ["kind", "name"]).select("entity_id", "kind", "name", "group_id")


def linked_pairs(links: DataFrame) -> DataFrame:
    """(entity_id_a, entity_id_b), a < b, of every two ids of one group."""
    ids = links.select("group_id", "entity_id").distinct()
    return (
        ids.withColumnRenamed("entity_id", "entity_id_a")
        .join(ids.withColumnRenamed("entity_id", "entity_id_b"), "group_id")
        .where("entity_id_a < entity_id_b")
        .select("entity_id_a", "entity_id_b")
        .distinct()
    )
