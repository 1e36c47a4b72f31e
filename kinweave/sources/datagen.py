"""Synthetic customers with known truth, made by Spark from ``range``: each value is a stable hash of its row and seed,
so any partitioning gives the same table and a lost task makes the same rows again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (smallest size, largest size, share of clusters).
DEMO_MIX = ((1, 1, 0.35), (2, 2, 0.25), (3, 5, 0.25), (6, 10, 0.15))
STANDARD_MIX = ((1, 1, 0.35), (2, 2, 0.25), (3, 5, 0.20), (6, 10, 0.12), (11, 50, 0.05), (51, 100, 0.02), (101, 200, 0.01))
FIRST = ("alice", "bob", "carol", "david", "erin", "frank", "grace", "henry", "irene", "jack")
LAST = ("smith", "jones", "brown", "taylor", "wilson", "davies", "evans", "thomas", "roberts", "walker")
DOMAINS = (("gmail.com", 0.4), ("yahoo.com", 0.2), ("outlook.com", 0.2), ("example.com", 0.2))
NICKNAMES = (("alice", "ally"), ("david", "dave"), ("henry", "hank"), ("thomas", "tom"), ("jack", "john"))
SOURCES = ("crm", "web", "pos", "app")


def draw(name: str, seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1), named by ``name``, for each key: the first eight hex digits of the MD5 of keys, name and seed."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(name), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def choose(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at * len(values)).cast("int") + 1)


def weighted(values: tuple[tuple[str, float], ...], at: Column) -> Column:
    """Categorical choice by cumulative cut-offs."""
    total, out = 0.0, None
    for value, share in values[:-1]:
        total += share
        out = F.when(at < total, value) if out is None else out.when(at < total, value)
    return F.lit(values[-1][0]) if out is None else out.otherwise(values[-1][0])


def noisy_email(email: Column, at: Column) -> Column:
    """Upper case for 2 %, a plus alias for 1 %, dots between letters of a gmail name for 1 %."""
    local, domain = F.substring_index(email, "@", 1), F.substring_index(email, "@", -1)
    return (
        F.when(at < 0.02, F.upper(email)).when(at < 0.03, F.concat(local, F.lit("+news@"), domain))
        .when((at < 0.04) & (domain == "gmail.com"), F.concat(F.regexp_replace(local, r"(?<=[a-z])(?=[a-z])", "."), F.lit("@"), domain)).otherwise(email)
    )


def noisy_phone(phone: Column, at: Column) -> Column:
    dashed = F.concat(F.substring(phone, 1, 3), F.lit("-"), F.substring(phone, 4, 3), F.lit("-"), F.substring(phone, 7, 4))
    return F.when(at < 0.02, F.concat(F.lit("+1"), phone)).when(at < 0.05, dashed).otherwise(phone)


def mutated_phone(phone: Column, rate: float, name: str, seed: int, *keys: str) -> Column:
    """With probability ``rate`` one digit is replaced by the next."""
    at = (draw(name + "at", seed, *keys) * F.length(phone)).cast("int") + 1
    digit = F.translate(F.substr(phone, at, F.lit(1)), "0123456789", "1234567890")
    return F.when(draw(name, seed, *keys) < rate, F.concat(F.substr(phone, F.lit(1), at - 1), digit, F.substr(phone, at + 1))).otherwise(phone)


def raw_phone(phone: Column, punctuated: Column, prefixed: Column, p_punctuation: float = 0.3, p_prefix: float = 0.2) -> Column:
    """Ten digits as people write them: ``(425) 555-1234`` and a leading +1, each with its share; the digits stay."""
    shown = F.when(punctuated < p_punctuation, F.concat(F.lit("("), F.substring(phone, 1, 3), F.lit(") "), F.substring(phone, 4, 3), F.lit("-"), F.substring(phone, 7, 4))).otherwise(phone)
    return F.when(prefixed < p_prefix, F.concat(F.lit("+1"), shown)).otherwise(shown)


def raw_email(email: Column, alias: Column, upper: Column, spaced: Column, p_alias: float = 0.05, p_upper: float = 0.1, p_spaces: float = 0.05) -> Column:
    """An address as people write it: a plus alias, upper case, blanks around it, each with its share."""
    out = F.when(alias < p_alias, F.replace(email, F.lit("@"), F.lit("+promo@"))).otherwise(email)
    out = F.when(upper < p_upper, F.upper(out)).otherwise(out)
    return F.when(spaced < p_spaces, F.concat(F.lit(" "), out, F.lit(" "))).otherwise(out)


#: Digits of postal codes by country; UK codes are letters and digits, HK has none.
POSTAL_DIGITS = (("US", 5), ("KR", 5), ("AU", 4), ("IN", 6))


def postal_code(country: Column, name: str, seed: int, *keys: str) -> Column:
    letter = lambda k: F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (draw(f"{name}{k}", seed, *keys) * 26).cast("int") + 1, F.lit(1))
    digit = lambda k: (draw(f"{name}{k}", seed, *keys) * 10).cast("int").cast("string")
    out = F.when(country == "UK", F.concat(letter("a"), letter("b"), digit("1"), F.lit(" "), digit("2"), letter("c"), letter("d")))
    for code, n in POSTAL_DIGITS:
        out = out.when(country == code, F.lpad((draw(name, seed, *keys) * 10**n).cast("long").cast("string"), n, "0"))
    return out


def delayed(at: Column, most_days: int, name: str, seed: int, *keys: str) -> Column:
    """A later time, by up to ``most_days`` in whole seconds."""
    return F.timestamp_seconds(F.unix_seconds(at) + (draw(name, seed, *keys) * (most_days * 86_400 + 1)).cast("long"))


def date_string(at: Column) -> Column:
    """Day of a time, as a partition's name."""
    return F.date_format(at, "yyyy-MM-dd")


def typo(value: Column, rate: float, name: str, seed: int, *keys: str) -> Column:
    """With probability ``rate`` one of: two letters swapped, one dropped, one replaced, one doubled."""
    n = F.length(value)
    at = (draw(name + "at", seed, *keys) * F.greatest(n - 1, F.lit(1))).cast("int") + 1
    head, a, b, tail = F.substr(value, F.lit(1), at - 1), F.substr(value, at, F.lit(1)), F.substr(value, at + 1, F.lit(1)), F.substr(value, at + 2)
    kind = draw(name + "kind", seed, *keys)
    changed = F.when(kind < 0.25, F.concat(head, b, a, tail)).when(kind < 0.5, F.concat(head, b, tail)).when(kind < 0.75, F.concat(head, F.lit("x"), b, tail)).otherwise(F.concat(head, a, a, b, tail))
    return F.when((draw(name, seed, *keys) < rate) & (n > 2), changed).otherwise(value)


def nickname(first: Column, rate: float, name: str, seed: int, *keys: str) -> Column:
    short = reduce(lambda c, p: F.when(first == p[0], p[1]).otherwise(c), NICKNAMES, first)
    return F.when(draw(name, seed, *keys) < rate, short).otherwise(first)


def customers(
    spark: SparkSession, persons: int, seed: int = 42, mix: tuple[tuple[int, int, float], ...] = DEMO_MIX, email_share: float = 0.6, phone_share: float = 0.4, loyalty_share: float = 0.3, typo_rate: float = 0.0, nickname_rate: float = 0.0,
) -> DataFrame:
    """(customer_id, person_id, source_system, first_name, last_name, email, phone, loyalty_id, created_at).

    Each person has as many records as their cluster size; the first is the anchor and shows every identifier, the
    others show each with its share, so that the truth is ``person_id``.
    """
    p = spark.range(persons).withColumnRenamed("id", "person_id")
    at, total, size = draw("size", seed, "person_id"), 0.0, None
    for low, high, share in mix:
        total += share
        n = F.lit(low) + (draw("within", seed, "person_id") * (high - low + 1)).cast("int")
        size = F.when(at < total, n) if size is None else size.when(at < total, n)
    p = p.withColumns({
        "first_name": choose(FIRST, draw("first", seed, "person_id")), "last_name": choose(LAST, draw("last", seed, "person_id")), "records": size.otherwise(F.lit(mix[-1][1])),
        "phone": F.lpad((F.col("person_id") + 2_000_000_000).cast("string"), 10, "0"), "loyalty_id": F.format_string("L%08d", "person_id"),
    })
    p = p.withColumn("email", F.concat_ws("", "first_name", F.lit("."), "last_name", F.col("person_id").cast("string"), F.lit("@"), weighted(DOMAINS, draw("domain", seed, "person_id"))))
    r = p.select("*", F.explode(F.sequence(F.lit(0), F.col("records") - 1)).alias("n"))
    key = ("person_id", "n")
    shown = lambda column, share: F.when((F.col("n") == 0) | (draw(column, seed, *key) < share), F.col(column))
    return r.select(
        F.concat_ws("-", F.lit("C"), "person_id", "n").alias("customer_id"), "person_id", choose(SOURCES, draw("source", seed, *key)).alias("source_system"),
        typo(nickname(F.col("first_name"), nickname_rate, "nick", seed, *key), typo_rate, "ft", seed, *key).alias("first_name"), typo(F.col("last_name"), typo_rate, "lt", seed, *key).alias("last_name"),
        noisy_email(shown("email", email_share), draw("en", seed, *key)).alias("email"), noisy_phone(shown("phone", phone_share), draw("pn", seed, *key)).alias("phone"), shown("loyalty_id", loyalty_share).alias("loyalty_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + (draw("at", seed, *key) * 31_536_000).cast("long")).alias("created_at"),
    )


def truth_links(people: DataFrame, table_id: str) -> DataFrame:
    return people.select(F.concat(F.lit(f"{table_id}:"), "customer_id").alias("entity_key"), "person_id")


def cluster_mix(people: DataFrame) -> DataFrame:
    """(size, clusters, share) of a generated table."""
    sizes = people.groupBy("person_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))
    return sizes.withColumn("share", F.col("clusters") / F.sum("clusters").over(Window.partitionBy()))


#: Tables of a retailer: (mean records a person, identifiers shown, own columns as (name, kind)). Kinds: id, choice, amount, date, text.
RETAIL = {
    "crm_customers": (1.0, ("customer_id", "email", "phone", "first_name", "last_name"), (("gender", "choice:F,M,X"), ("country", "choice:US,UK,HK,KR,AU,IN"))),
    "loyalty_members": (0.6, ("customer_id", "loyalty_id", "email", "phone"), (("tier", "choice:BRONZE,SILVER,GOLD"), ("status", "choice:ACTIVE,LAPSED"))),
    "web_accounts": (0.8, ("customer_id", "account_id", "email", "phone"), (("country", "choice:US,UK,HK,KR,AU,IN"),)),
    "ecom_orders": (2.5, ("customer_id", "email", "phone"), (("product_id", "id:5000"), ("total_amount", "amount:500"), ("currency", "choice:USD,GBP,EUR"))),
    "pos_transactions": (3.0, ("loyalty_id", "email", "phone"), (("store_id", "id:200"), ("product_id", "id:5000"), ("total_amount", "amount:300"))),
    "customer_support_tickets": (0.3, ("email", "phone"), (("issue_type", "choice:RETURN,BILLING,DELIVERY"), ("channel", "choice:PHONE,MAIL,CHAT"))),
    "web_events": (6.0, ("account_id", "email"), (("device_id", "id:100000"), ("event_type", "choice:VIEW,CART,BUY"))),
    "app_events": (4.0, ("account_id",), (("device_id", "id:100000"), ("event_type", "choice:OPEN,VIEW,BUY"), ("app_version", "choice:1.0,1.1,2.0"))),
}


def retail_table(spark: SparkSession, name: str, persons: int, seed: int = 42, email_share: float = 0.6, phone_share: float = 0.5, typo_rate: float = 0.02) -> DataFrame:
    """One of the tables of ``RETAIL``: (record_id, person_id, identifiers..., own columns..., created_at, updated_at, created_date).

    A person has up to twice the table's mean number of records. Noise is in e-mails and phones only, so that ``person_id`` is
    the truth.
    """
    mean, shown, own = RETAIL[name]
    p = spark.range(persons).withColumnRenamed("id", "person_id")
    n = F.floor(draw(f"{name}n", seed, "person_id") * (2 * mean + 1)).cast("int")
    r = p.withColumn("n", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    key = ("person_id", "n")
    first, last = choose(FIRST, draw("first", seed, "person_id")), choose(LAST, draw("last", seed, "person_id"))
    email = F.concat(first, F.lit("."), last, F.col("person_id").cast("string"), F.lit("@"), weighted(DOMAINS, draw("domain", seed, "person_id")))
    phone = F.lpad((F.col("person_id") + 2_000_000_000).cast("string"), 10, "0")
    d = lambda what: draw(f"{name}{what}", seed, *key)
    known = {
        "customer_id": F.col("person_id"), "loyalty_id": F.format_string("L%08d", "person_id"), "account_id": F.format_string("A%08d", "person_id"),
        "first_name": typo(first, typo_rate, f"{name}ft", seed, *key), "last_name": typo(last, typo_rate, f"{name}lt", seed, *key),
        "email": F.when(d("e") < email_share, raw_email(email, d("ea"), d("eu"), d("es"))), "phone": F.when(d("p") < phone_share, raw_phone(phone, d("pp"), d("px"))),
    }

    def column(what: str, kind: str) -> Column:
        how, _, rest = kind.partition(":")
        if how == "choice":
            return choose(tuple(rest.split(",")), d(what))
        return (d(what) * int(rest)).cast("long") if how == "id" else F.round(d(what) * int(rest), 2)

    created = F.timestamp_seconds(F.lit(1_704_067_200) + (d("at") * 31_536_000).cast("long"))
    out = r.select(F.concat_ws("-", F.lit(name), *key).alias("record_id"), "person_id", "n", *[known[c].alias(c) for c in shown], *[column(c, k).alias(c) for c, k in own], created.alias("created_at"))
    return out.withColumn("updated_at", delayed(F.col("created_at"), 30, f"{name}late", seed, *key)).withColumn("created_date", date_string(F.col("created_at"))).drop("n")


def retail(spark: SparkSession, persons: int, seed: int = 42) -> dict[str, DataFrame]:
    return {name: retail_table(spark, name, persons, seed) for name in RETAIL}
