"""Column expressions over header text: words, dictionary cuts, base tokens, trigrams.

Everything is an expression over one header, so the whole chain runs in one narrow stage over distinct headers.
The lexicon is configuration and becomes literals: ``isin`` turns into a hash-set test.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..lexicon import UNKNOWN_WEIGHT, Lexicon
from .cells import WHITE_SPACE, bind, clean, fold_accents

MIN_SLICE = 3
FUZZY_BAR = 0.7
TOKEN_GAP = 3
VOCABULARY_GAP = 2


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_strings(values: list[str]) -> str:
    return f"array({', '.join(map(sql_text, values))})" if values else "cast(array() as array<string>)"


def strings(values: list[str]) -> Column:
    """Literal array; one parsed text is far quicker to build than one call per word."""
    return F.expr(sql_strings(values))


def among(value: Column, words: list[str]) -> Column:
    """Membership in a literal list, which Spark turns into a hash set."""
    return value.isin(words)


def words(text: Column, camel: bool = True) -> Column:
    """Lower-case alphanumeric words; ``camel`` also cuts between a small and a capital letter."""
    spaced = F.regexp_replace(text, "[_-]", " ")
    if camel:
        spaced = F.regexp_replace(spaced, "([a-z])([A-Z])", "$1 $2")
    plain = F.regexp_replace(F.lower(spaced), "[^a-z0-9]+", " ")
    return F.filter(F.split(F.coalesce(plain, F.lit("")), " "), lambda w: w != "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)


def dictionary_split(word: Column, lexicon: Lexicon) -> Column:
    """The word itself when known or uncuttable, else its first cut into two known words."""
    known = lexicon.vocabulary
    single = F.array(word)
    cuts = F.filter(F.sequence(F.lit(1), F.length(word) - 1), lambda i: (
        among(F.substring(word, F.lit(1), i), known) & among(F.substring(word, i + 1, F.length(word)), known)))
    parts = bind(F.get(cuts, F.lit(0)), lambda cut: F.when(cut.isNull(), single).otherwise(
        F.array(F.substring(word, F.lit(1), cut), F.substring(word, cut + 1, F.length(word)))))
    return F.when(among(word, known) | (F.length(word) < 2), single).otherwise(parts)


def standard_tokens(text: Column, lexicon: Lexicon) -> Column:
    return F.flatten(F.transform(words(text), lambda w: dictionary_split(w, lexicon)))


def deep_move(word: Column, at: Column, lexicon: Lexicon) -> Column:
    """What the left-to-right segmenter does at offset ``at``: (taken, token), or null to skip one letter.

    The longest known slice wins; else the most similar known word (longer slice first, then vocabulary order), which
    then replaces the slice. Slices beyond the longest word + 2 can match nothing and are not looked at.
    """
    known = lexicon.vocabulary
    longest = max(len(w) for w in known)
    near = F.expr("array(" + ", ".join(sql_strings([w for w in known if abs(len(w) - n) <= VOCABULARY_GAP])
                                       for n in range(longest + VOCABULARY_GAP + 1)) + ")")
    rest = F.length(word) - at
    lengths = F.when(rest >= MIN_SLICE, F.sequence(
        F.least(rest, F.lit(longest + VOCABULARY_GAP)), F.lit(MIN_SLICE), F.lit(-1)))

    def slice_of(n: Column) -> Column:
        return F.substring(word, at + 1, n)

    def better(best: Column, n: Column, piece: Column, candidate: Column) -> Column:
        return bind(similarity(piece, candidate), lambda s: F.when(s > best["score"], F.struct(
            s.alias("score"), n.alias("taken"), candidate.alias("token"))).otherwise(best))

    nothing = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("taken"), F.lit("").alias("token"))
    fuzzy = F.aggregate(lengths, nothing, lambda best, n: bind(slice_of(n), lambda piece: F.aggregate(
        F.get(near, n), best, lambda b, candidate: better(b, n, piece, candidate))))
    exact = F.get(F.filter(lengths, lambda n: among(slice_of(n), known)), F.lit(0))
    return bind(exact, lambda n: F.when(n.isNotNull(), F.struct(n.alias("taken"), slice_of(n).alias("token")))
                .when(lengths.isNotNull(), bind(fuzzy, lambda f: F.when(
                    f["score"] >= FUZZY_BAR, F.struct(f["taken"].alias("taken"), f["token"].alias("token"))))))


def segment_walk(word: Column, move: Callable[[Column], Column]) -> Column:
    """Segment a run-together word by the moves (taken, token) at the offsets the walk visits."""
    start = F.struct(F.lit(0).alias("next"), F.lit("").alias("unknown"), F.array().cast("array<string>").alias("out"))

    def flushed(s: Column) -> Column:
        return F.when(s["unknown"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["unknown"])))

    def step(s: Column, at: Column) -> Column:
        moved = bind(move(at), lambda m: F.when(m.isNull(), F.struct(
            (at + 1).alias("next"), F.concat(s["unknown"], F.substring(word, at + 1, F.lit(1))).alias("unknown"),
            s["out"].alias("out"))).otherwise(F.struct(
                (at + m["taken"]).alias("next"), F.lit("").alias("unknown"),
                F.concat(flushed(s), F.array(m["token"])).alias("out"))))
        return F.when(at < s["next"], s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(0), F.length(word) - 1), start, step, flushed)


def deep_segments(word: Column, lexicon: Lexicon) -> Column:
    """Segment a run-together word with the words of the lexicon."""
    return segment_walk(word, lambda at: deep_move(word, at, lexicon))


def lemmas(tokens: Column, lexicon: Lexicon) -> Column:
    """Left to right, the longest run of 3, 2 or 1 tokens that is a synonym becomes its base token's words."""
    phrases = lexicon.synonyms
    if not phrases:
        return tokens
    longest = min(3, max(len(p.split(" ")) for p in phrases))
    table = F.expr(f"map_from_arrays({sql_strings(list(phrases))}, array({', '.join(map(sql_strings, phrases.values()))}))")
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))

    def run(row: Column, i: Column, n: int) -> Column:
        text = F.get(row, i)
        for k in range(1, n):
            text = F.concat(text, F.lit(" "), F.get(row, i + k))  # null past the end, so no match there
        return bind(F.try_element_at(table, text), lambda base: F.when(
            base.isNotNull(), F.struct(F.lit(n).alias("taken"), base.alias("words"))))

    def step(row: Column, s: Column, i: Column) -> Column:
        itself = F.struct(F.lit(1).alias("taken"), F.array(F.get(row, i)).alias("words"))
        choice = F.coalesce(*[run(row, i, n) for n in range(longest, 0, -1)], itself)
        moved = bind(choice, lambda c: F.struct(
            (i + c["taken"]).alias("next"), F.concat(s["out"], c["words"]).alias("out")))
        return F.when(i < s["next"], s).otherwise(moved)

    # The row's tokens are bound first: the optimiser would otherwise copy their expression into every step.
    return bind(tokens, lambda row: F.when(F.size(row) == 0, row).otherwise(F.aggregate(
        F.sequence(F.lit(0), F.size(row) - 1), start, lambda s, i: step(row, s, i), lambda s: s["out"])))


def without_stop_words(tokens: Column, lexicon: Lexicon) -> Column:
    return F.filter(tokens, lambda t: ~among(t, lexicon.stop_words)) if lexicon.stop_words else tokens


def weighted(tokens: Column, lexicon: Lexicon) -> Column:
    """Tokens with their weights."""
    table = F.expr(f"map_from_arrays({sql_strings(list(lexicon.weights))}, "
                   f"array({', '.join(f'{w!r}D' for w in lexicon.weights.values())}))")
    return F.transform(tokens, lambda t: F.struct(
        t.alias("token"), F.coalesce(F.try_element_at(table, t), F.lit(UNKNOWN_WEIGHT)).alias("weight")))


def signature_literal(lexicon: Lexicon) -> Column:
    """All signatures as one literal array of (sig_pos, total weight, [(token, weight)])."""
    out = []
    for pos, tokens in enumerate(lexicon.signatures.values()):
        total = 0.0
        for token in tokens:
            total += lexicon.weights[token]
        parts = ", ".join(f"named_struct('token', {sql_text(t)}, 'weight', {lexicon.weights[t]!r}D)" for t in tokens)
        out.append(f"named_struct('sig_pos', {pos}, 'total', {total!r}D, 'tokens', array({parts}))")
    return F.expr(f"array({', '.join(out)})")


def token_outcome(token: Column, signature: Column) -> Column:
    """How one weighted token fares against a signature: (outcome, similarity, against, weight added to each side)."""
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("token"), F.lit(0.0).alias("weight"))

    def better(best: Column, other: Column) -> Column:
        gap = F.abs(F.length(token["token"]) - F.length(other["token"]))
        score = F.when(gap <= TOKEN_GAP, similarity(token["token"], other["token"])).otherwise(F.lit(0.0))
        return bind(score, lambda s: F.when(s > best["score"], F.struct(
            s.alias("score"), other["token"].alias("token"), other["weight"].alias("weight"))).otherwise(best))

    def result(outcome, score, against, matched, added):
        return F.struct(F.lit(outcome).alias("outcome"), score.alias("similarity"), against.alias("against"),
                        matched.alias("matched"), added.alias("added"))

    exact = F.exists(signature["tokens"], lambda other: other["token"] == token["token"])
    fuzzy = F.aggregate(signature["tokens"], nothing, better)
    return F.when(exact, result("exact", F.lit(1.0), token["token"], token["weight"], token["weight"])).otherwise(
        bind(fuzzy, lambda f: F.when(f["score"] >= FUZZY_BAR, result(
            "fuzzy", f["score"], f["token"], f["score"] * f["weight"], f["weight"])).otherwise(result(
                "noise", F.lit(0.0), F.lit(None).cast("string"), F.lit(0.0), token["weight"]))))


def shares_letters(word: Column, known: list[str]) -> Column:
    """Whether a letter of the word is in any known word; if not, its similarity to all of them is 0."""
    letters = "".join(sorted(set("".join(known))))
    return F.translate(word, letters, "") != word


def meets_signature(token: Column, lexicon: Lexicon) -> Column:
    """Whether a token equals or resembles a signature word; any other token is noise to every signature."""
    known = list(dict.fromkeys([w for tokens in lexicon.signatures.values() for w in tokens] + list(lexicon.weights)))
    longest = max(map(len, known), default=0)
    near = F.expr("array(" + ", ".join(sql_strings([w for w in known if abs(len(w) - n) <= TOKEN_GAP])
                                       for n in range(longest + TOKEN_GAP + 1)) + ")")
    resembles = F.exists(F.get(near, F.length(token)), lambda w: (w == token) | (similarity(token, w) >= FUZZY_BAR))
    return F.coalesce(shares_letters(token, known) & resembles, F.lit(False))


def token_fares(token: Column, lexicon: Lexicon) -> Column:
    """What a token adds: its weight, and (sig_pos, matched, added) for each signature it is more than noise to."""
    one = F.get(weighted(F.array(token), lexicon), F.lit(0))
    outcomes = bind(one, lambda t: F.transform(signature_literal(lexicon), lambda signature: bind(token_outcome(t, signature), lambda o: F.struct(
        signature["sig_pos"].alias("sig_pos"), o["matched"].alias("matched"), o["added"].alias("added"), o["outcome"].alias("outcome")))))
    hits = F.transform(F.filter(outcomes, lambda o: o["outcome"] != "noise"), lambda o: F.struct(
        o["sig_pos"].alias("sig_pos"), o["matched"].alias("matched"), o["added"].alias("added")))
    return F.struct(one["weight"].alias("weight"), hits.alias("hits"))


def summed_scores(listed: Column, lexicon: Lexicon) -> Column:
    """Weighted overlap with the signatures from a list of (pos, weight, hits): array of (sig_pos, score), score > 0 only.

    Sums run in token order, so results do not depend on partitioning. Only signatures that a token hits can score.
    """
    totals = F.expr("array(" + ", ".join(f"{sum(lexicon.weights[t] for t in tokens)!r}D" for tokens in lexicon.signatures.values()) + ")")
    zero = F.expr("named_struct('matched', 0.0D, 'added', 0.0D)")

    def add(s: Column, x: Column, at: Column) -> Column:
        return bind(F.get(F.filter(x["hits"], lambda h: h["sig_pos"] == at), F.lit(0)), lambda h: F.struct(
            (s["matched"] + F.coalesce(h["matched"], F.lit(0.0))).alias("matched"),
            (s["added"] + F.coalesce(h["added"], x["weight"])).alias("added")))

    def score(at: Column) -> Column:
        value = bind(F.aggregate(listed, zero, lambda s, x: add(s, x, at)), lambda s: bind(
            F.get(totals, at) + s["added"] - s["matched"], lambda d: F.when(d <= 0, F.lit(0.0)).otherwise(
                F.least(F.lit(1.0), s["matched"] / d))))
        return F.struct(at.alias("sig_pos"), value.alias("score"))

    hit = F.sort_array(F.array_distinct(F.flatten(F.transform(listed, lambda x: x["hits"]["sig_pos"]))))
    return F.filter(F.transform(hit, score), lambda p: p["score"] > 0)


# --- the lexical matcher's normal forms ---

def cleanse(text: Column) -> Column:
    """Trimmed, lower-cased, accents folded, punctuation dropped, white space runs turned into ``_``."""
    kept = F.regexp_replace(fold_accents(F.lower(clean(text))), f"[^a-z0-9_{WHITE_SPACE}]", "")
    return F.regexp_replace(kept, f"[{WHITE_SPACE}]+", "_")


def trigrams(text: Column) -> Column:
    """Distinct three-letter windows over the text padded with two spaces at each end."""
    # Bound, as a lambda works out again for every window what it does not take as an argument.
    return bind(F.concat(F.lit("  "), text, F.lit("  ")), lambda padded: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))))


def trigram_similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(shared / either)


def search_tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), f"[{WHITE_SPACE}]+"), lambda t: F.regexp_replace(t, "[^a-z0-9]", "")),
                    lambda t: t != "")


def typo_variant(text: Column) -> Column:
    return F.translate(text, "ao", "eu")


def fingerprint(headers: Column) -> Column:
    """SHA-256 over the header names, lower-cased, letters and digits of every script; equal for files of one layout."""
    normal = F.transform(headers, lambda h: F.regexp_replace(F.lower(h), "[^\\p{L}\\p{N}]+", ""))
    return F.sha2(F.concat_ws("|", normal), 256)


def explicit_measure(source: Column) -> Column:
    """The header itself names an amount or a count."""
    return F.lower(source).rlike("amount|value|cost|sum|number|count|qty|freq")


def is_plural(source: Column) -> Column:
    return source.rlike("s([^A-Za-z0-9_]|$)") | F.lower(source).rlike("orders|invoices|payments")
