"""PII: every detected entity is replaced by a keyed surrogate of its own kind.

Surrogates keep the format (signs stay in place, digits become digits), names
keep gender and script.  The same entity, however it is written, gets the same
surrogate everywhere; different entities get different ones: the draws for all
different entities of the corpus are compared with each other and with the real
entities, and colliding ones are drawn again.  Built-in functions only.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrahaz.llm.common import documents, keyed, matched, written

# kind -> pattern; the first kind that fits a find whole is its kind
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)",
    "phone": (r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|"
              r"(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"),
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<!\d)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "man": r"(?:Mr|Herr|Señor|Monsieur|Господин|г-н)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
    "woman": r"(?:Mrs|Ms|Miss|Frau|Señora|Madame|Госпожа|г-жа)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
# text without any of these signs holds no entity: a cheap test before the patterns
HINT = r"@|\d{3}|\d\.\d|[0-9a-fA-F]{32}|Mr|Mrs|Ms|Miss|Herr|Frau|Señor|M(?:onsieur|adame)|Госп|г-"
GIVEN = {
    ("man", "latin"): "Adam Boris Carl David Emil Felix Georg Henry Ivan Jonas Karl Louis Martin Nils Oscar Paul".split(),
    ("woman", "latin"): "Anna Berta Clara Doris Emma Flora Gerda Hanna Irene Julia Karin Laura Maria Nora Olga Paula".split(),
    ("man", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Марк Никита Олег Павел Роман Семён".split(),
    ("woman", "cyrillic"): "Анна Белла Вера Галина Дарья Ева Зоя Инна Клара Лариса Мария Нина Ольга Полина Раиса Софья".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ko la le lo ma me mo na ne no pa ra re ro sa se ta te to".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ха хе ка ко ла ле ло ма ме мо на не но па ра ре ро са се та те то".split(),
}
KEY_SETTING = "spark.terrahaz.surrogates.key"  # without it a run draws its own key
TRIES = 8


def kind_of(surface: Column) -> Column:
    return reduce(lambda rest, k: F.when(surface.rlike(f"^(?:{KINDS[k]})$"), k).otherwise(rest), reversed(list(KINDS)), F.lit("other"))


def norm_of(kind: Column, surface: Column) -> Column:
    """What writings of one entity have in common: e-mail and secret in lower case, digits and letters of numbers, names without title."""
    return (F.when(kind.isin("email", "secret"), F.lower(surface)).when(kind == "ip", surface)
            .when(kind.isin("man", "woman"), F.regexp_replace(surface, r"^\S+ ", ""))
            .otherwise(F.regexp_replace(surface, r"[^0-9A-Za-z]", "")))


def _numbers(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """128 keyed numbers 0..255."""
    text = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), norm)
    hexes = F.concat(F.sha2(text, 512), F.sha2(F.concat(text, F.lit("|")), 512))
    return F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.conv(F.substr(hexes, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))


def _masked(norm: Column, numbers: Column, kept_head: Column, kept_tail: Column, letters: Column) -> Column:
    """Digits become keyed digits, letters keyed letters of their case (out of the first ``letters``); other signs stay."""
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(norm), F.lit(1))), lambda i: F.substr(norm, i, F.lit(1)))
    n = F.length(norm)

    def one(c, i):
        v = F.get(numbers, i % 128)
        return (F.when((i < kept_head) | (i >= n - kept_tail), c)
                .when(c.rlike(r"^\d$"), (v % 10).cast("string"))
                .when(c.rlike("^[a-z]$"), F.char(F.lit(97) + v % letters))
                .when(c.rlike("^[A-Z]$"), F.char(F.lit(65) + v % letters)).otherwise(c))

    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 10


def _name(gender: str, norm: Column, numbers: Column) -> Column:
    def lists(script):
        given = F.array(*[F.lit(x) for x in GIVEN[gender, script]])
        syllables = F.array(*[F.lit(x) for x in SYLLABLES[script]])
        pick = lambda array, i, n: F.get(array, F.get(numbers, F.lit(i)) % n)
        family = F.initcap(F.concat(*[pick(syllables, i, 32) for i in range(1, 6)]))
        return F.when(norm.contains(" "), F.concat(pick(given, 0, 16), F.lit(" "), family)).otherwise(family)

    return F.when(norm.rlike(r"\p{IsCyrillic}"), lists("cyrillic")).otherwise(lists("latin"))


def draw(entities: DataFrame, key: str) -> DataFrame:
    """``core`` of each (kind, norm, attempt): the surrogate in its normal form."""
    kind, norm = F.col("kind"), F.col("norm")
    numbered = entities.withColumn("_v", _numbers(kind, norm, F.col("attempt"), key))
    v, zero, all_letters = F.col("_v"), F.lit(0), F.lit(26)
    tail = F.length(F.substring_index(norm, ".", -1)) + 1  # the last label of a mail address stays
    card = _masked(norm, v, F.lit(1), F.lit(1), all_letters)
    head = F.expr("substr(_card, 1, length(_card) - 1)")
    octet = lambda i: (F.get(v, F.lit(i)) % (223 if i == 0 else 256) + (1 if i == 0 else 0)).cast("string")
    core = (F.when(kind == "email", _masked(norm, v, zero, tail, all_letters))
            .when(kind == "secret", _masked(norm, v, zero, zero, F.lit(6)))
            .when(kind == "ip", F.concat_ws(".", *[octet(i) for i in range(4)]))
            .when(kind == "iban", _masked(norm, v, F.lit(2), zero, all_letters))
            .when(kind == "phone", _masked(norm, v, F.lit(1), zero, all_letters))
            .when(kind == "card", F.concat(head, ((_luhn(norm) - _luhn(F.concat(head, F.lit("0"))) + 10) % 10).cast("string")))
            .when(kind == "man", _name("man", norm, v)).when(kind == "woman", _name("woman", norm, v))
            .otherwise(_masked(norm, v, zero, zero, all_letters)))
    return numbered.withColumn("_card", card).withColumn("core", core).drop("_v", "_card")


def surrogate_map(entities: DataFrame, key: str, tries: int = TRIES) -> DataFrame:
    """kind, norm, core: one distinct core per distinct entity, none equal to a real entity of its kind.

    Every round draws for the entities still open and keeps the draws nobody
    else holds; ties go to the smaller norm.  After ``tries`` rounds what is left
    (a format with fewer values than entities) gets a keyed hash instead.
    """
    entities = written(entities.select("kind", "norm").distinct(), "pii-entities")
    real = entities.select("kind", F.col("norm").alias("core"), F.lit(True).alias("_real"))
    settled, attempt = None, 0
    todo = entities
    while attempt < tries:
        drawn = draw(todo.withColumn("attempt", F.lit(attempt)), key).select("kind", "norm", "core")
        ranked = drawn.withColumn("_rank", F.row_number().over(Window.partitionBy("kind", "core").orderBy("norm")))
        marked = ranked.join(real, ["kind", "core"], "left")
        if settled is not None:
            marked = marked.join(settled.select("kind", "core", F.lit(True).alias("_taken")), ["kind", "core"], "left")
        else:
            marked = marked.withColumn("_taken", F.lit(None).cast("boolean"))
        judged = written(marked.select("kind", "norm", "core", (
            (F.col("_rank") == 1) & F.col("_real").isNull() & F.col("_taken").isNull()).alias("free")), "pii-draws")
        free = judged.where("free").select("kind", "norm", "core")
        settled = free if settled is None else settled.unionByName(free)
        todo = judged.where(~F.col("free")).select("kind", "norm")
        attempt += 1
        if todo.isEmpty():
            return settled
    rest = todo.select("kind", "norm", F.sha2(F.concat_ws("|", F.lit(key), "kind", "norm"), 256).alias("core"))
    return settled.unionByName(rest)


def rendered(kind: Column, surface: Column, core: Column) -> Column:
    """The core in the writing of the occurrence: its signs, its case, its title."""
    gaps = F.split(surface, "[0-9A-Za-z]", -1)
    chars = F.split(core, "")
    filled = F.array_join(F.zip_with(gaps, chars, lambda g, c: F.concat(F.coalesce(g, F.lit("")), F.coalesce(c, F.lit("")))), "")
    fits = F.size(gaps) == F.length(core) + 1
    cased = F.array_join(F.zip_with(chars, F.split(surface, ""), lambda c, s: F.when(s.rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    return (F.when(kind.isin("man", "woman"), F.concat(F.regexp_extract(surface, r"^\S+ ", 0), core))
            .when(kind.isin("phone", "ssn", "iban", "card") & fits, filled)
            .when(kind.isin("email", "secret") & (surface == F.upper(surface)), F.upper(core))
            .when(kind == "secret", cased).otherwise(core))


def secret_key(spark) -> str:
    """The session's key, else a random one: nobody can rebuild a run's map from the source."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def replace_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """All rows and columns, entities in ``text`` replaced; one more column ``n_entities``.

    Null and empty texts, and texts without an entity, come back as they are
    (n_entities 0); repeated rows are changed alike; an empty table gives an
    empty result; other columns pass through untouched whatever their names
    (except ``n_entities``, which is overwritten).  Only documents with an entity
    are shuffled.  The key, given or the session's ``spark.terrahaz.surrogates.key``,
    decides the surrogates: same key, same corpus, same result.
    """
    key = key or secret_key(docs.sparkSession)
    names = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*names)
    found = F.col("text").rlike(HINT) & F.col("text").rlike(ANY)
    surfaces = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    holders = written(keyed(docs.where(found), surfaces.alias("surfaces")).distinct(), "pii-holders")
    places = holders.select("_id", "_th", F.posexplode("surfaces").alias("at", "surface"))
    typed = places.withColumn("kind", kind_of(F.col("surface"))).withColumn("norm", norm_of(F.col("kind"), F.col("surface")))
    cores = surrogate_map(typed, key)
    filled = (typed.join(cores, ["kind", "norm"])
              .select("_id", "_th", F.struct("at", rendered(F.col("kind"), F.col("surface"), F.col("core")).alias("new")).alias("r"))
              .groupBy("_id", "_th").agg(F.array_sort(F.collect_list("r")).alias("_new")))
    held, key_names, named = matched(docs.where(found), filled, "inner")
    gaps = F.split("text", ANY, -1)
    new = F.array_join(F.zip_with(gaps, F.transform(named["_new"], lambda r: r["new"]),
                                  lambda g, n: F.concat(F.coalesce(g, F.lit("")), F.coalesce(n, F.lit("")))), "")
    counted = F.size(named["_new"]).cast("long")
    swapped = held.withColumns({"n_entities": counted, "text": new}).drop(*key_names, named["_new"])
    plain = docs.where(~F.coalesce(found, F.lit(False))).withColumn("n_entities", F.lit(0).cast("long"))
    return plain.unionByName(swapped)


def op6_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_pii(documents(spark, sf_dir)).select("doc_id", "text", "n_entities")
