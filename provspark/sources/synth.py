"""Synthetic customers and mails, derived row by row from a table of ids.

Every value is a function of the md5 of (seed, id), so any number of tasks, in any order and
after any restart, produces the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 18102022
MAILS_PER_CUSTOMER = 10
FIRST_DATE, DAYS = "2022-08-01", 685  # dates from 2022-08-01 to 2024-06-15, both included

# Fixed values of the generated tables.
TARGET_COUNTRIES = ("UK", "DE", "FR")
NEGATIVE_SUBJECTS = ("Urgent question", "Please help me", "Complaint!!!")
POSITIVE_SUBJECTS = ("Thanks!", "Great bank", "You are awesome")

BANKS = ("Alder", "Birch", "Cedar", "Elm", "Fir", "Hazel", "Larch", "Maple", "Oak", "Pine")
BANK_FORMS = ("Bank", "Group", "and Sons", "Ltd")
POSITIVE_TEXTS = (
    "Your friendly team opened my bank account within a day. Great work.",
    "Thanks for the helpful advice about my bank account and the nice card.",
    "I am happy to recommend you. The bank account is excellent.",
    "Moving my bank account to you was the best choice I made all year.",
    "A quick note to thank everybody who looks after my bank account.",
)
NEGATIVE_TEXTS = (
    "I have a complaint. The terrible app failed again and I am angry.",
    "This is my second complaint about a wrong fee. It is unacceptable.",
    "Your service is the worst and my complaint was never answered.",
    "My bank account shows a wrong balance and nobody fixes the problem.",
    "A broken card reader and a bad hotline: please treat this as a complaint.",
)


def _draw(digest: Column, i: int) -> Column:
    """The i-th of four uniform numbers in [0, 1) from an md5."""
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") / float(2**32)


def _pick(values, u: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int"))


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def customers(ids: DataFrame, id_column: str = "id", seed: int = SEED) -> DataFrame:
    """One customer per id: 75% from the UK, Germany or France, 10% premium."""
    cid = F.col(id_column).cast("long")
    place, status = _digest(F.lit("place"), F.lit(seed), cid), _digest(F.lit("status"), F.lit(seed), cid)
    letter = lambda u: F.char(F.lit(65) + F.floor(u * 26))
    anywhere = F.concat(letter(_draw(place, 2)), letter(_draw(place, 3)))
    country = F.when(_draw(place, 0) > 0.25, _pick(TARGET_COUNTRIES, _draw(place, 1))).otherwise(anywhere)
    return ids.select(
        cid.alias("customer_id"),
        F.concat(F.lit("user"), cid, F.lit("@example.org")).alias("customer_email"),
        F.concat_ws(" ", _pick(BANKS, _draw(status, 0)), _pick(BANK_FORMS, _draw(status, 1))).alias("bank"),
        country.alias("country"),
        F.when(_draw(status, 2) > 0.9, "premium").otherwise("standard").alias("level"),
    )


def mails(customers_df: DataFrame, per_customer: int = MAILS_PER_CUSTOMER, seed: int = SEED) -> DataFrame:
    """Mails of the customers: 40% complaints; 1% of the German ones leak a card number."""
    df = customers_df.select(
        "customer_id", "customer_email", "country",
        F.explode(F.sequence(F.lit(0), F.lit(per_customer - 1))).alias("n"),
    )
    df = df.withColumn("h", _digest(F.lit("mail"), F.lit(seed), "customer_id", "n"))
    df = df.withColumn("g", _digest(F.lit("more"), F.lit(seed), "customer_id", "n"))
    negative = _draw(F.col("h"), 1) > 0.6
    u = _draw(F.col("h"), 2)
    card = F.lpad(F.conv(F.substring("g", 9, 13), 16, 10), 16, "4")
    leak = negative & (F.col("country") == "DE") & (_draw(F.col("h"), 3) > 0.99)
    subject = F.when(negative, _pick(NEGATIVE_SUBJECTS, u)).otherwise(_pick(POSITIVE_SUBJECTS, u))
    text = F.when(negative, _pick(NEGATIVE_TEXTS, _draw(F.col("g"), 0))).otherwise(
        _pick(POSITIVE_TEXTS, _draw(F.col("g"), 0))
    )
    date = F.date_add(F.lit(FIRST_DATE).cast("date"), F.floor(_draw(F.col("h"), 0) * DAYS).cast("int"))
    uuid = F.concat_ws("-", *[F.substring("h", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return df.select(
        uuid.alias("mail_id"),
        F.col("customer_email").alias("email"),
        date.cast("string").alias("raw_date"),
        F.when(leak, F.concat(subject, F.lit(" My credit card is "), card)).otherwise(subject).alias("mail_subject"),
        text.alias("mail_text"),
    )


def write_example(ids: DataFrame, path: str, id_column: str = "id", seed: int = SEED) -> dict[str, str]:
    """Write both tables as header-less CSV; returns the source paths of the example run."""
    people = customers(ids, id_column, seed)
    paths = {"customers_path": f"{path}/customers", "mails_path": f"{path}/mails"}
    people.write.csv(paths["customers_path"])
    mails(people, seed=seed).write.csv(paths["mails_path"])
    return paths
