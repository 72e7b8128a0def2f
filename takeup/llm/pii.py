"""Surrogates for personal data, in DataFrame functions only.

Detected entities are replaced by values of the same type and form that depend on a key:
e-mail addresses, IPv4 addresses, phone, card and social security numbers, IBANs, and
names after a form of address. A surrogate is drawn from a keyed hash of the entity's
*canonical* form, so all spellings of one entity (case, spacing) get the same one
(coreference), and each spelling keeps its form: separators, case, digits for digits,
a valid card number for a valid one, an address of the same shape, a name of the same gender
and script.

Distinctness is checked, not assumed: all entities of the corpus are gathered once per type, and
those whose surrogate another entity has, or which is itself a real entity, are drawn again
with the next round number until none is left. The tables hold one narrow row per distinct
entity. Only documents with entities are rebuilt.

Null texts stay null, empty texts empty; texts without entities are not touched. Rows are told apart by
id and text, so repeated rows get equal results. Other columns travel in one struct and may have
any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from takeup.llm.common import row_key, stage

# fixed values: forms of address by gender
TITLES = {"m": ("Mr", "Herr", "Señor", "Monsieur", "господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "госпожа"),
          "n": ("Mx", "Dr", "Prof")}
_ALL_TITLES = "|".join(t for titles in TITLES.values() for t in titles)

#: type: pattern; the first that matches the whole value names its type
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}_.%+-])[\p{L}\p{M}\p{N}_.%+-]++@[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]++)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ -]?)?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
             r"|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
             r"|(?<![0-9A-Za-z.-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9A-Za-z]|[.-][0-9])",
    "name": rf"\p{{Lu}}(?<=(?<!\p{{L}})(?:{_ALL_TITLES})\.? \p{{Lu}})[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

# fixed values: syllables by script
SYLLABLES = {
    "latin": "ba be da de ga ka la le ma mi na no ra ri sa ta".split(),
    "cyrillic": "ба бе да де га ка ла ле ма ми на но ра ри са та".split(),
}
ENDINGS = {"latin": {"m": "n", "f": "ia", "n": "is", "s": "ert"}, "cyrillic": {"m": "н", "f": "я", "n": "е", "s": "ко"}}


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_of(value: str) -> str:
    cases = " ".join(f"when {value} rlike {sql_text(f'^(?:{PATTERNS[k].split(chr(124) + '(?<')[0]})$')} then '{k}'"
                     for k in ("email", "iban", "card", "ip", "ssn"))
    return f"case {cases} when {value} rlike '[0-9]{{2}}' then 'phone' else 'name' end"


def canonical(kind: str, value: str) -> str:
    return (f"case when {kind} in ('card', 'phone', 'ssn') then regexp_replace({value}, '[^0-9]', '')"
            f" when {kind} = 'iban' then replace({value}, ' ', '') when {kind} = 'ip' then {value} else lower({value}) end")


def mentions(scanned: DataFrame) -> DataFrame:
    """``_k1, _k2, place, part, value, kind, canon`` of every entity of ``pieces`` and ``values``.

    A name of two words gives its parts as entities of their own (``given_*``, ``surname``),
    so a surname alone still refers to the same person.
    """
    found = scanned.select("_k1", "_k2", F.posexplode(F.expr(
        "zip_with(slice(pieces, 1, size(values)), values, (p, v) -> struct(v as value, right(p, 24) as lead))"))
        .alias("place", "z"))
    rows = found.select("_k1", "_k2", "place", "z.*")
    rows = rows.withColumn("kind", F.expr(kind_of("value")))
    title = f"regexp_extract(lead, '({_ALL_TITLES})[.]? $', 1)"
    gender = " ".join(f"when {title} in ({', '.join(map(sql_text, t))}) then '{g}'" for g, t in TITLES.items())
    rows = rows.withColumn("gender", F.expr(f"case {gender} else 'n' end")).drop("lead")
    parts = F.expr("""case when kind <> 'name' then array(struct(kind as kind, value as value))
        when instr(value, ' ') = 0 then array(struct('surname' as kind, value as value))
        else array(struct(concat('given_', gender) as kind, split_part(value, ' ', 1) as value),
                   struct('surname' as kind, split_part(value, ' ', 2) as value)) end""")
    rows = rows.select("_k1", "_k2", "place", F.posexplode(parts).alias("part", "p")).select(
        "_k1", "_k2", "place", "part", "p.*")
    return rows.withColumn("canon", F.expr(canonical("kind", "value"))).distinct()


def _draw(key: str) -> str:
    """SQL for the canonical surrogate of ``kind, canon, round`` from hash ``h`` (64 hex digits)."""
    digits = "translate(h, 'abcdef', '012345')"
    letters = "translate(h, '0123456789', 'ghijklmnop')"
    fill = f"""array_join(transform(split(canon, ''), (c, i) -> case
        when c rlike '[0-9]' then substring({digits}, i % 64 + 1, 1)
        when c rlike '[a-z]' or c rlike '[^\\\\x00-\\\\x7F]' then substring({letters}, i % 64 + 1, 1)
        when c rlike '[A-Z]' and i > 1 then upper(substring({letters}, i % 64 + 1, 1)) else c end), '')"""
    # numbers keep their first digit: network of a card, country of a phone number
    number = f"concat(left(canon, 1), substring({digits}, 2, length(canon) - 1))"
    card = f"""case when {luhn('canon')} % 10 = 0 then concat(left({number}, length(canon) - 1),
        cast((10 - {luhn(f"concat(left({number}, length(canon) - 1), '0')")} % 10) % 10 as string)) else {number} end"""
    octet = "cast(conv(substring(h, {0}, 4), 16, 10) as int)"
    ip = "concat_ws('.', " + ", ".join([f"{octet.format(1)} % 223 + 1"] + [f"{octet.format(i)} % 256" for i in (5, 9, 13)]) + ")"
    cases = []
    for script, rest in (("cyrillic", "canon rlike '\\\\p{IsCyrillic}'"), ("latin", "true")):
        table = "array(" + ", ".join(map(sql_text, SYLLABLES[script])) + ")"
        stem = (f"array_join(transform(sequence(1, 3 + round div 3), i -> element_at({table}, "
                "cast(conv(substring(h, i, 1), 16, 10) as int) + 1)), '')")
        for ending, kinds in (("m", "given_m"), ("f", "given_f"), ("n", "given_n"), ("s", "surname")):
            cases.append(f"when kind = '{kinds}' and {rest} then concat({stem}, {sql_text(ENDINGS[script][ending])})")
    # an address too short for its neighbours grows after some rounds
    email = f"if(round < 4, {fill}, concat(substring({letters}, 1, round), {fill}))"
    return (f"case when kind = 'email' then {email} when kind = 'ip' then {ip} when kind = 'iban' then {fill}"
            f" when kind = 'card' then {card} when kind in ('phone', 'ssn') then {number} {' '.join(cases)} end")


def luhn(digits: str) -> str:
    """SQL for the check sum of a string of digits."""
    at = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return (f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + if(i % 2 = 0, {at}, "
            f"{at} * 2 - if({at} > 4, 9, 0)))")


def surrogates(entities: DataFrame, key: str, max_rounds: int = 24) -> DataFrame:
    """``kind, canon, surrogate`` of distinct entities, no two alike within a kind."""
    def draw(rows: DataFrame) -> DataFrame:
        hashed = rows.withColumn("h", F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", F.col("round").cast("string")), 256))
        return hashed.withColumn("surrogate", F.expr(_draw(key))).drop("h")

    names = F.expr("if(kind like 'given%', 'given', kind)").alias("space")
    rows = stage(draw(entities.select("kind", "canon", F.lit(0).alias("round"))), "surrogates_0")
    real = stage(entities.select(names, F.col("canon").alias("surrogate")).distinct(), "entities")
    for step in range(1, max_rounds + 1):
        taken = rows.withColumn("space", names)
        first = taken.groupBy("space", "surrogate").agg(
            F.min(F.struct(F.col("round"), "kind", "canon")).alias("first"), F.count("*").alias("n"))
        bad = taken.join(first.where("n > 1"), ["space", "surrogate"]).where(
            "struct(round, kind, canon) <> first").select("kind", "canon")
        bad = bad.union(taken.join(real, ["space", "surrogate"], "left_semi").select("kind", "canon")).distinct()
        bad = stage(bad, "surrogate_clashes")
        if bad.isEmpty():
            return rows.select("kind", "canon", "surrogate")
        again = draw(rows.join(bad, ["kind", "canon"], "left_semi").select("kind", "canon", (F.col("round") + 1).alias("round")))
        rows = stage(rows.join(bad, ["kind", "canon"], "left_anti").unionByName(again), f"surrogates_{step}")
    raise RuntimeError("no distinct surrogates found")


def in_form(value: str, kind: str, surrogate: str) -> str:
    """SQL for a surrogate in the form of one spelling."""
    seen = f"length(regexp_replace(substring({value}, 1, i + 1), '[^0-9]', ''))"
    number = (f"array_join(transform(split({value}, ''), (c, i) -> if(c rlike '[0-9]', substring({surrogate}, {seen}, 1), c)), '')")
    unspaced = f"length(replace(substring({value}, 1, i + 1), ' ', ''))"
    spaced = f"array_join(transform(split({value}, ''), (c, i) -> if(c = ' ', c, substring({surrogate}, {unspaced}, 1))), '')"
    return (f"case when {kind} in ('card', 'phone', 'ssn') then {number} when {kind} = 'iban' then {spaced}"
            f" when {kind} = 'ip' then {surrogate} when {value} = upper({value}) and length({value}) > 1 then upper({surrogate})"
            f" when {value} = lower({value}) then {surrogate} when {kind} = 'email' then {surrogate} else initcap({surrogate}) end")


def pseudonymize(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text",
                 carry: list[str] | None = None) -> DataFrame:
    """``row`` (carried columns, default all but the text), ``text`` with surrogates and ``n_entities``.

    One scan writes the texts with their entities; only texts that have any are split,
    joined with their surrogates and put together again.
    """
    carry = [c for c in docs.columns if c != text_column] if carry is None else carry
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), *row_key(id_column, text_column),
                       F.col(text_column).alias("text"),
                       F.expr(f"regexp_extract_all(`{text_column}`, {sql_text(ANY)}, 0)").alias("values"))
    rows = stage(rows, "pii_texts")
    clean, hit = rows.where("values is null or size(values) = 0"), rows.where("size(values) > 0")
    hit = hit.withColumn("pieces", F.expr(f"split(text, {sql_text(ANY)}, -1)"))
    seen = stage(mentions(hit), "pii_mentions")
    table = surrogates(seen.select("kind", "canon").distinct(), key)
    # very frequent entities: the table has one row each, a hot one on the other side is split
    new = seen.join(table, ["kind", "canon"]).withColumn("new", F.expr(in_form("value", "kind", "surrogate")))
    per_doc = new.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list(F.struct("place", "part", "new"))).alias("parts"))
    rebuilt = """array_join(flatten(transform(pieces, (piece, i) -> array(piece, array_join(transform(
        filter(parts, p -> p.place = i), p -> p.new), ' ')))), '')"""
    done = hit.join(per_doc, ["_k1", "_k2"]).select("row", F.expr(rebuilt).alias("text"),
                                                    F.size("values").cast("long").alias("n_entities"))
    return clean.select("row", "text", F.lit(0).cast("long").alias("n_entities")).unionByName(done)


def pii_report(docs: DataFrame, key: str = "takeup", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text with surrogates, number of entities."""
    return pseudonymize(docs, key, id_column, text_column, [id_column]).select(
        F.col(f"row.{id_column}").alias(id_column), F.col("text").alias(text_column), "n_entities")
