"""Word lists that drive header recognition and matching.

A lexicon is configuration, not data: it is sized by the target schema (tens of fields, hundreds of words), held
on the driver and shipped inside expressions. Alias dictionaries that are data are given as a table and joined instead
(see ``operators.keywords``).
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

UNKNOWN_WEIGHT = 0.2

# The target schema (id, label, required, type) in its fixed order.
TARGETS = [
    ("supplier_id", "Supplier ID", True, "alphanumeric"),
    ("supplier_name", "Supplier Name", True, "string"),
    ("supplier_alias", "Supplier Alias", False, "string"),
    ("supplier_legal_name", "Supplier Legal name", True, "string"),
    ("street_address", "Street Address", True, "string"),
    ("city_state", "City State", True, "string"),
    ("postal_code", "Postal Code", True, "alphanumeric"),
    ("country", "Country", True, "string"),
    ("phone_number", "Phone Number", True, "string"),
    ("email_address", "Email Address", True, "string"),
    ("tax_id", "Tax Id", True, "string"),
    ("payment_terms", "Payment Terms", True, "string"),
    ("payment_method", "Payment Method", True, "string"),
    ("currency", "Currency", True, "string"),
    ("total_invoices", "Total Number of Invoices", True, "integer"),
    ("total_purchase_orders", "Total Number of Purchase Orders", True, "integer"),
    ("total_payments_paid", "Total Number of Payments Paid", True, "integer"),
    ("total_payments_due", "Total Number of Payments Due", True, "integer"),
    ("total_payments_open", "Total Number of Payments Open", True, "integer"),
    ("transaction_count", "Transaction Count", True, "integer"),
    ("total_amount_invoices", "Total Amount of Invoices", True, "decimal"),
    ("total_amount_purchase_orders", "Total Amount of Purchase Orders", True, "decimal"),
    ("total_amount_payments_paid", "Total Amount of Payments Paid", True, "decimal"),
    ("total_amount_payments_due", "Total Amount of Payments Due", True, "decimal"),
    ("total_amount_payments_open", "Total Amount of Payments Open", True, "decimal"),
    ("annual_target_spend", "Annual Target Spend", True, "decimal"),
]

# Words that carry no meaning in a header.
STOP_WORDS = "of the all for and to is a an in on at by with details info information data".split()

# The tokens that stand for each target, in target order.
SIGNATURES = {
    "supplier_id": "supplier id",
    "supplier_name": "supplier name",
    "supplier_alias": "supplier alias",
    "supplier_legal_name": "supplier legal name",
    "street_address": "street address",
    "city_state": "city state",
    "postal_code": "postal code",
    "country": "country",
    "phone_number": "phone number",
    "email_address": "email",
    "tax_id": "tax id",
    "payment_terms": "payment terms",
    "payment_method": "payment method",
    "currency": "currency",
    "total_invoices": "total number invoices",
    "total_purchase_orders": "total number purchase orders",
    "total_payments_paid": "total number payment paid",
    "total_payments_due": "total number payment due",
    "total_payments_open": "total number payment open",
    "transaction_count": "transaction number",
    "total_amount_invoices": "total amount invoices",
    "total_amount_purchase_orders": "total amount purchase orders",
    "total_amount_payments_paid": "total amount payment paid",
    "total_amount_payments_due": "total amount payment due",
    "total_amount_payments_open": "total amount payment open",
    "annual_target_spend": "annual target spend",
}

def other_number(word: str) -> list[str]:
    """Plural of a singular word and the other way round, for words of four letters or more."""
    if len(word) < 4 or word.endswith(("ss", "us")):
        return []
    return [word[:-1]] if word.endswith("s") else [word[:-1] + "ies"] if word.endswith("y") else [word + "s"]


def abbreviations(word: str) -> list[str]:
    """Short forms of a word of five letters or more: its first four letters, and its letters without the inner vowels."""
    if len(word) < 5:
        return []
    skeleton = word[0] + "".join(b for a, b in zip(word, word[1:], strict=False) if b not in "aeiou" and b != a)
    return [s for s in (word[:4], skeleton) if len(s) >= 3 and s != word]


def word_forms(words: list[str]) -> dict[str, list[str]]:
    """For each word its other number and short forms; a form that is a word itself, or of two words, stands for none."""
    every = {w: list(dict.fromkeys(f for n in [w, *other_number(w)] for f in [n, *abbreviations(n)])) for w in words}
    times = Counter(f for forms in every.values() for f in forms)
    return {w: [f for f in forms if f != w and f not in every and times[f] == 1] for w, forms in every.items()}


def default_synonyms() -> dict[str, list[str]]:
    """Forms of the words of the signatures. Words that mean the same come from outside, through ``load_lexicon``."""
    found = word_forms(list(dict.fromkeys(w for words in SIGNATURES.values() for w in words.split())))
    return {word: forms for word, forms in found.items() if forms}


def default_aliases() -> dict[str, list[str]]:
    """For each target its label, its signature, both without blanks and with short forms, and the words no other label has."""
    out = {}
    in_labels = Counter(w for _, label, _, _ in TARGETS for w in set(label.lower().split()))
    forms = word_forms(list(dict.fromkeys(w for _, label, _, _ in TARGETS for w in label.lower().split() if w not in STOP_WORDS)))
    for target, label, _, _ in TARGETS:
        words = [w for w in label.lower().split() if w not in STOP_WORDS]
        phrases = [" ".join(words), SIGNATURES[target]]
        if words[0] == "total":  # what is measured, then the measure
            phrases.append(" ".join([*words[2:], words[1]]))
        for k, word in enumerate(words):
            phrases += [" ".join([*words[:k], form, *words[k + 1:]]) for form in forms[word]]
        phrases += [p.replace(" ", "") for p in phrases[:2]]
        phrases += [f for w in words if in_labels[w] == 1 for f in [w, *other_number(w)]]
        out[target.replace("_", " ")] = list(dict.fromkeys([label.lower(), *phrases]))
    return out


@dataclass(frozen=True)
class Target:
    target_id: str
    label: str
    required: bool
    data_type: str


@dataclass(frozen=True)
class Lexicon:
    """Stop words, synonyms, signatures and aliases for one target schema."""

    targets: list[Target]
    stop_words: list[str]
    base_tokens: dict[str, list[str]]
    raw_signatures: dict[str, list[str]]
    aliases: dict[str, list[str]] = field(default_factory=dict)

    # --- derived values used as literals inside expressions ---

    @cached_property
    def synonyms(self) -> dict[str, list[str]]:
        """Phrase -> words of its base token; the last base that lists a phrase wins."""
        return {s: base.split(" ") for base, phrases in self.base_tokens.items() for s in phrases}

    @cached_property
    def signatures(self) -> dict[str, list[str]]:
        """Signatures with each token replaced once by its base token."""
        return {
            target: [w for token in tokens for w in self.synonyms.get(token, [token])]
            for target, tokens in self.raw_signatures.items()
        }

    @cached_property
    def vocabulary(self) -> list[str]:
        """Every known word or phrase, first appearance first."""
        phrases = [w for base, syn in self.base_tokens.items() for w in (base, *syn)]
        signature_words = [w for words in self.signatures.values() for w in words]
        return list(dict.fromkeys([*self.stop_words, *phrases, *signature_words]))

    @cached_property
    def weights(self) -> dict[str, float]:
        """1 / (number of signatures holding the token)."""
        found: dict[str, int] = {}
        for words in self.signatures.values():
            for word in set(words):
                found[word] = found.get(word, 0) + 1
        return {word: 1.0 / n for word, n in found.items()}

    @cached_property
    def keywords(self) -> list[str]:
        return list(dict.fromkeys(a.lower() for phrases in self.aliases.values() for a in phrases))

    @cached_property
    def target_ids(self) -> list[str]:
        return [t.target_id for t in self.targets]

    # --- the same content as tables ---

    def target_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t.target_id, t.label, t.required, t.data_type) for i, t in enumerate(self.targets)]
        return spark.createDataFrame(
            rows, "target_pos int, target_id string, label string, required boolean, data_type string")

    def stop_word_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, w) for i, w in enumerate(self.stop_words)], "word_pos int, word string")

    def synonym_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, base, j, s) for i, (base, phrases) in enumerate(self.base_tokens.items())
                for j, s in enumerate(phrases)]
        return spark.createDataFrame(rows, "base_pos int, base_token string, syn_pos int, synonym string")

    def signature_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, target, j, w) for i, (target, words) in enumerate(self.raw_signatures.items())
                for j, w in enumerate(words)]
        return spark.createDataFrame(rows, "sig_pos int, target_id string, token_pos int, token string")

    def alias_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, key, j, a) for i, (key, phrases) in enumerate(self.aliases.items())
                for j, a in enumerate(phrases)]
        return spark.createDataFrame(rows, "key_pos int, target_key string, alias_pos int, alias string")


# --- table-level builds -----------------------------------------------------------------------------------------

def synonym_inverse(synonyms: DataFrame) -> DataFrame:
    """synonym -> base token, last base listed wins."""
    return synonyms.groupBy("synonym").agg(F.max_by("base_token", "base_pos").alias("base_token"))


def lemmatised_signatures(signatures: DataFrame, inverse: DataFrame) -> DataFrame:
    """Signature tokens replaced once through the inverse table, order kept."""
    joined = signatures.join(
        inverse.select(F.col("synonym").alias("token"), "base_token"), "token", "left")
    words = joined.select("sig_pos", "target_id", "token_pos",
                          F.posexplode(F.split(F.coalesce("base_token", "token"), " ")).alias("word_pos", "word"))
    return words.select("sig_pos", "target_id", "token_pos", "word_pos", F.col("word").alias("token"))


def token_weights(lemmatised: DataFrame) -> DataFrame:
    """token, number of signatures that hold it, and its weight."""
    return (lemmatised.groupBy("token").agg(F.countDistinct("target_id").alias("n_signatures"))
            .withColumn("weight", F.lit(1.0) / F.col("n_signatures")))


def vocabulary_table(stop_words: DataFrame, synonyms: DataFrame, lemmatised: DataFrame) -> DataFrame:
    """Distinct words in order of first appearance: stop words, then bases with synonyms, then signature tokens."""
    parts = (
        stop_words.select("word", F.struct(F.lit(0).alias("part"), F.col("word_pos").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("at"))
        .unionByName(synonyms.select(F.col("base_token").alias("word"),
                                     F.struct(F.lit(1).alias("part"), F.col("base_pos").alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("c")).alias("at")))
        .unionByName(synonyms.select(F.col("synonym").alias("word"),
                                     F.struct(F.lit(1).alias("part"), F.col("base_pos").alias("a"), F.col("syn_pos").alias("b"), F.lit(0).alias("c")).alias("at")))
        .unionByName(lemmatised.select(F.col("token").alias("word"),
                                       F.struct(F.lit(2).alias("part"), F.col("sig_pos").alias("a"), F.col("token_pos").alias("b"), F.col("word_pos").alias("c")).alias("at")))
    )
    first = parts.groupBy("word").agg(F.min("at").alias("at"))
    # A vocabulary is a word list of the configuration, not data: one ordered window over it is small.
    return first.select("word", (F.row_number().over(W.orderBy("at")) - 1).alias("vocab_pos"))


# --- construction -------------------------------------------------------------------------------------------------

def default_targets() -> list[Target]:
    return [Target(*row) for row in TARGETS]


def default_lexicon() -> Lexicon:
    return Lexicon(
        targets=default_targets(),
        stop_words=list(STOP_WORDS),
        base_tokens=default_synonyms(),
        raw_signatures={target: words.split() for target, words in SIGNATURES.items()},
        aliases=default_aliases(),
    )


def load_lexicon(config_path: str, alias_path: str | None = None) -> Lexicon:
    """Lexicon from JSON files.

    ``config_path`` holds ``matching_engine_config.nlp_config.{stop_words,base_tokens}`` and
    ``matching_engine_config.target_signatures`` (keyed by target label); ``alias_path`` maps a target key to phrases.
    Signatures whose label is not in the target schema are ignored.
    """
    with open(config_path, encoding="utf-8") as handle:
        config = json.load(handle)["matching_engine_config"]
    aliases = {}
    if alias_path:
        with open(alias_path, encoding="utf-8") as handle:
            aliases = json.load(handle)
    targets = default_targets()
    by_label = {t.label: t.target_id for t in targets}
    return Lexicon(
        targets=targets,
        stop_words=config["nlp_config"]["stop_words"],
        base_tokens=config["nlp_config"]["base_tokens"],
        raw_signatures={by_label[label]: words for label, words in config["target_signatures"].items()
                        if label in by_label},
        aliases=aliases,
    )
