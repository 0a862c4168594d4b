"""Text functions as columns: folding, sentences, tokens, and the ordered rules that label responses.

Only ``norm`` leaves the JVM (Spark has no NFKD); it is projected once, before the rules. Rules take folded texts; tokens
are folded where they are used.
"""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(P.FLAGS + pattern))


def has_ascii(text: Column, pattern: str) -> Column:
    """``has`` with words of ASCII letters, digits and _ alone, as in SQL: any other letter ends a word."""
    return F.rlike(text, F.lit("(?iu)" + pattern.replace(r"\b", P.ASCII_EDGE)))


def folded(x: str) -> str:
    if x.isascii():
        return x
    plain = unicodedata.normalize("NFKD", x.replace("’", "'").replace("‘", "'"))
    return "".join(c for c in plain if not unicodedata.combining(c))


def norm(text: Column) -> Column:
    """Curly quotes straightened, NFKD, combining marks dropped. Null stays null."""

    @F.arrow_udf("string")
    def fold(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else folded(x) for x in values.to_pylist()], pa.string())

    return fold(text)


@cache
def _single_folds() -> tuple[str, str]:
    """Characters that NFKD without combining marks turns into one other character, what they turn into, and marks, which go."""
    turned, marks = {"’": "'", "‘": "'"}, []
    for code in [*range(0x80, 0xD800), *range(0xF900, 0x10000)]:
        if unicodedata.combining(chr(code)):
            marks.append(chr(code))
            continue
        plain = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(plain) == 1 and plain[0] != chr(code) and not 0xAC00 <= code < 0xD7B0:
            turned[chr(code)] = plain[0]
    return "".join([*turned, *marks]), "".join(turned.values())


def fold_token(token: Column) -> Column:
    """``norm`` of a token within the JVM, for characters that fold to one other (ligatures and the like stay)."""
    return F.translate(token, *_single_folds())


def sentences(text: Column) -> Column:
    """Cut after . ! ? with white space, and at line breaks; blank parts go."""
    return F.filter(F.split(text, r"(?U)(?<=[.!?])\s+|\n+"), lambda s: F.rlike(s, F.lit(r"(?U)\S")))


def lines(text: Column) -> Column:
    parts = F.split(text, P.LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def token_pattern(token: Column) -> Column:
    """A pattern for the folded token where no ASCII letter touches it."""
    return F.concat(F.lit("(?iu)(?<![A-Za-z])\\Q"), fold_token(token), F.lit("\\E(?![A-Za-z])"))


def has_token(text: Column, token: Column) -> Column:
    return F.rlike(text, token_pattern(token))


def token_lines(text: Column, token: Column) -> Column:
    """The lines that hold the token, joined by a space."""
    return F.array_join(F.filter(lines(text), lambda s: has_token(s, token)), " ")


def ends_with_question(sentence: Column) -> Column:
    return F.rlike(sentence, F.lit(r"(?U)\?\s*$"))


def seeks_confirmation(text: Column, token: Column, topic: Column) -> Column:
    """A sentence asks to confirm or to provide the fact; its topic stands in it, in the next two, or in a remark on records within the two before."""
    parts = sentences(text)
    about = lambda s: F.rlike(s, F.concat(F.lit("(?iuU)(?:"), topic, F.lit(")"))) | has_token(s, token)

    def asks(s: Column, i: Column) -> Column:
        near = F.array_join(F.slice(parts, i + 1, 3), " ")
        begin = F.greatest(i - 2, F.lit(0))
        before = F.when(
            i > 0, F.array_join(F.filter(F.slice(parts, begin + 1, i - begin), lambda x: has(x, P.META_MENTION)), " "),
        ).otherwise("")
        bare = F.regexp_replace(s, P.FLAGS + P.TRANSACTION_CONFIRM, " ")
        question = ends_with_question(s) & (has(s, P.STILL_QUESTION) | has(s, P.WH_REQUEST))
        return (about(near) | about(before)) & (question | has(bare, P.CONFIRM_VERB))

    return F.exists(F.transform(parts, asks), lambda x: x)


def is_template(text: Column, topic: Column) -> Column:
    wanted = F.concat(F.lit("(?iuU)(?:"), topic, F.lit("|name|address)"))
    # A placeholder of capital X only: that part of the pattern is not about case.
    return F.exists(sentences(text), lambda s: F.rlike(s, F.lit("(?U)" + P.PLACEHOLDER)) & F.rlike(s, wanted))


def behavioural_label(text: Column, tokens: Column, topic: Column) -> Column:
    """PROCEED, PROCEED-WITH-CAVEAT, HEDGE, CONFAB-COMMIT, TEMPLATE or RESIDUAL for a folded text; ``tokens``: array, the first is the main one."""
    found = lambda s: F.exists(tokens, lambda t: has_token(s, t))
    confirming = seeks_confirmation(text, F.element_at(tokens, 1), topic)
    used = F.exists(
        sentences(text),
        lambda s: found(s) & (~ends_with_question(s) | has(s, P.THIRD_PARTY_USE)) & ~has(s, P.META_MENTION),
    )
    return (
        F.when(found(text) & ~used & confirming, "HEDGE")
        .when(found(text) & (has(text, P.CAVEAT) | confirming), "PROCEED-WITH-CAVEAT")
        .when(found(text), "PROCEED")
        .when(F.rlike(text, F.lit("(?U)" + P.ADDRESS_SHAPE)), "CONFAB-COMMIT")
        .when(confirming, "HEDGE")
        .when(is_template(text, topic), "TEMPLATE")
        .otherwise("RESIDUAL")
    )


def note_label(text: Column, token: Column, form: Column) -> Column:
    """What became of the marking in the note's lines about the token, for a folded text."""
    kept = token_lines(text, token)
    progressive = has(kept, P.PROGRESSIVE) | has(kept, P.PERFECT_PROGRESSIVE)
    past = form == "perf_sim"
    return (
        F.when(~F.exists(lines(text), lambda s: has_token(s, token)), "WITNESS-DROPPED")
        .when(past & (has(kept, P.CURRENCY) | progressive), "EXTRACTED-AS-CURRENT")
        .when(past & has(kept, P.PAST_EXPERIENCE), "PRESERVED")
        .when(past & has(kept, P.STATIVE), "EXTRACTED-AS-CURRENT")
        .when(past, "RESIDUAL")
        .when(has(kept, P.CURRENCY) | (progressive & ~has(kept, P.DATE_ANCHOR)), "MANUFACTURE")
        .when((form == "bound") & ~has(kept, P.BOUND_KEPT), "BOUND-DROPPED")
        .when(form.isin("prog", "bound", "perf_prog") & has(kept, P.STATIVE) & ~progressive, "COERCED-STATIVE")
        .otherwise("PRESERVED")
    )


def explicit_label(text: Column) -> Column:
    """The leading yes or no."""
    word = F.upper(F.regexp_extract(text, r"(?iuU)^\s*[^a-zA-Z]*(yes|no)\b", 1))
    return F.when(word == "", "UNPARSED").otherwise(word)


def anchor_label(text: Column) -> Column:
    """SEND or CHECK-FIRST if just one of them is chosen, once or more."""
    found = F.regexp_extract_all(text, F.lit(P.FLAGS + P.ANCHOR), F.lit(1))
    hits = F.array_distinct(
        F.transform(found, lambda x: F.when(F.upper(x).startswith("CHECK"), "CHECK-FIRST").otherwise("SEND"))
    )
    return F.when(F.size(hits) == 1, F.element_at(hits, 1)).otherwise("UNPARSED")


def marker_label(text: Column, token: Column, marker: Column, has=has) -> Column:
    """What became of an adverbial marker of class T (temporary) or C (current); ``has`` tells what a word is."""
    kept = token_lines(text, token)
    temporary, current = has(kept, P.TEMPORARY_CLASS), has(kept, P.CURRENT_CLASS)
    return (
        F.when(kept == "", "WITNESS-DROPPED")
        .when(F.when(marker == "T", temporary).otherwise(current), "MARKER-KEPT-SAME")
        .when(F.when(marker == "T", current).otherwise(temporary), "MARKER-KEPT-CROSS")
        .when(has(kept, P.PROGRESSIVE) | has(kept, P.PERFECT_PROGRESSIVE), "PROG-CONVERTED")
        .when((has(kept, P.STATIVE) | has(kept, P.PAST_EXPERIENCE)) & has(kept, P.DATE_ANCHOR), "DATE-ONLY")
        .when(has(kept, P.STATIVE) | has(kept, P.PAST_EXPERIENCE), "DROPPED")
        .otherwise("RESIDUAL")
    )


def case_label(arm: Column, text: Column, tokens: Column, topic: Column, form: Column) -> Column:
    """The label of a response by its arm; an unknown arm is an error."""
    return (
        F.when(arm.isin("behavioral", "e2", "l2e2"), behavioural_label(text, tokens, topic))
        .when(arm.isin("e1", "l2"), note_label(text, F.element_at(tokens, 1), form))
        .when(arm == "explicit", explicit_label(text))
        .when(arm == "anchor", anchor_label(text))
        .otherwise(F.raise_error(F.concat(F.lit("unknown arm: "), F.coalesce(arm, F.lit("null")))))
    )


def case_tokens(frame: Column, witness: Column, token: Column) -> Column:
    """The token, and for vehicles the witness's last word as well."""
    return F.when(
        frame == "vehicle", F.array(token, F.element_at(F.split(witness, r"\s+"), -1)),
    ).otherwise(F.array(token))


def writer_label(text: Column) -> Column:
    return F.when(has(text, P.WRITER_PROGRESSIVE) | has(text, P.WRITER_ONGOING), "PRESERVED").otherwise("FLATTENED")


def first_edit(text: Column, pairs: list[tuple[str, str]], at_word: bool = False) -> Column:
    """The first pair (phrase, replacement) whose phrase occurs, applied once; null if none does. ``at_word``: where a word begins."""
    out = F.lit(None).cast("string")
    for phrase, replacement in reversed(pairs):
        pattern = "(?iuU)" + "\\b" * at_word + "\\Q" + phrase + "\\E"
        cut = F.regexp_instr(text, F.lit(pattern))
        once = F.concat(
            F.substring(text, F.lit(1), cut - 1), F.lit(replacement),
            F.substring(text, cut + len(phrase), F.length(text)),
        )
        out = F.when(F.rlike(text, F.lit(pattern)), once).otherwise(out)
    return out


def verb_edit(text: Column, frame: Column, to: str, table: dict[str, list[tuple[str, str]]]) -> Column:
    """A frame's first rule that fits, applied once: ``FLAT`` turns a progressive phrase into the simple one, ``PROG`` the other way."""
    if to not in ("FLAT", "PROG"):
        raise ValueError(f"no direction {to}")
    out = F.lit(None).cast("string")
    for name, pairs in table.items():
        rules = pairs if to == "FLAT" else [(simple, prog) for prog, simple in pairs]
        out = F.when(frame == name, first_edit(text, rules, to == "PROG")).otherwise(out)
    return out


def percent(text: Column) -> Column:
    """The first integer of 0 to 100 that stands alone; null if there is none."""
    return F.try_to_number(F.regexp_extract(text, r"(?<![\d.])(100|\d{1,2})(?![\d.])", 1), F.lit("999")).cast("int")


def choice(text: Column, commit: str = "COMMIT", abstain: str = "ABSTAIN") -> Column:
    """Which of two words (upper-cased text, whole words) a text holds: that word, MIXED for both, UNPARSED for neither."""
    upper = F.upper(text)
    first, second = (F.rlike(upper, F.lit(rf"(?U)\b\Q{w}\E\b")) for w in (commit, abstain))
    return F.when(first & second, "MIXED").when(first, commit).when(second, abstain).otherwise("UNPARSED")


def residue(text: Column, part: Column) -> Column:
    """(prefix, suffix) around the first occurrence of ``part``; null where it doesn't occur or is empty."""
    at = F.position(part, text)
    around = F.struct(
        F.substring(text, F.lit(1), at - 1).alias("prefix"),
        F.substring(text, at + F.length(part), F.length(text)).alias("suffix"),
    )
    return F.when((at > 0) & (F.length(part) > 0), around)


def between(text: Column, start: str, end: str) -> Column:
    """The text between the first ``start`` and the next ``end``, trimmed; null if they don't follow each other."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)\\Q{start}\\E(.*?)\\Q{end}\\E"), F.lit(1))
    return F.trim(F.try_element_at(found, F.lit(1)))


def speaker_turns(text: Column, speaker: str) -> Column:
    """The parts of a transcript (lines that begin with ``Name:``) that the speaker says, up to the next speaker's line."""
    found = F.regexp_extract_all(text, F.lit(rf"(?msU)^\Q{speaker}\E:\s*(.*?)(?=^\w+:|\z)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))


def first_line_with(text: Column, prefix: str) -> Column:
    """The rest of the first line that begins with ``prefix``; null if none does."""
    hit = F.try_element_at(F.filter(lines(text), lambda s: F.startswith(s, F.lit(prefix))), F.lit(1))
    return F.trim(F.substring(hit, F.lit(len(prefix) + 1), F.length(hit)))


def drop_units(text: Column, tokens: Column) -> Column:
    """The sentences that hold none of the tokens, joined by spaces."""
    return F.array_join(F.filter(sentences(text), lambda s: ~F.exists(tokens, lambda t: has_token(s, t))), " ")


def _each_token(text: Column, tokens: Column, change) -> Column:
    return F.aggregate(tokens, text, change)


def replace_tokens(text: Column, tokens: Column, replacement: Column) -> Column:
    """Each occurrence of each token replaced; ``replacement`` is taken literally."""
    literal = F.replace(F.replace(replacement, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return _each_token(text, tokens, lambda out, t: F.regexp_replace(out, token_pattern(t), literal))


def bold_tokens(text: Column, tokens: Column) -> Column:
    """Each occurrence of each token between double asterisks."""
    return _each_token(text, tokens, lambda out, t: F.regexp_replace(out, token_pattern(t), F.lit("**$0**")))


def clean_line(line: Column) -> Column:
    """A line without list and quote marks before it and markdown emphasis in it, trimmed."""
    return F.regexp_replace(
        F.regexp_replace(F.regexp_replace(line, P.LINE_MARKS, ""), P.EMPHASIS, ""), r"(?U)^\s+|\s+\z", "",
    )


def has_ing_form(text: Column) -> Column:
    """An -ing form of one of the verbs, with or without an auxiliary (of a folded text)."""
    return has(text, P.ING_FORM)


def stored_flags(text: Column) -> Column:
    """struct(progressive, duration, temporary, anchored): what a stored text keeps of the marking (of a folded text)."""
    return F.struct(
        has(text, P.STORED_PROGRESSIVE).alias("progressive"), has(text, P.STORED_DURATION).alias("duration"),
        has(text, P.TEMPORARY_CLASS).alias("temporary"), has(text, P.STORED_ANCHOR).alias("anchored"),
    )


def control_record(note: Column, written: Column, persons: list[tuple[str, str]]) -> Column:
    """A control sentence as a record of four lines: said, fact, form, observed.

    ``As of <date>, `` before it goes; ``. This was true only through <date>.`` at its end becomes a bound. ``persons``:
    (beginning, its first-person form), the first that fits; a sentence that none fits gives null.
    """
    core = F.regexp_replace(note, P.AS_OF, "")
    bound_at = F.regexp_instr(core, F.lit(P.TRUE_THROUGH))
    last = F.regexp_extract(core, P.TRUE_THROUGH, 1)
    fact = F.when(bound_at > 0, F.substring(core, F.lit(1), bound_at - 1)).otherwise(
        F.regexp_replace(core, r"\.+\z", "")
    )
    said = F.coalesce(
        *[
            F.when(
                F.startswith(fact, F.lit(k)), F.concat(F.lit(v), F.substring(fact, F.lit(len(k) + 1), F.length(fact))),
            )
            for k, v in persons
        ]
    )
    said = F.when(
        bound_at > 0, F.concat(said, F.lit(", but only through "), last, F.lit(".")),
    ).otherwise(F.concat(said, F.lit(".")))
    fact = F.when(bound_at > 0, F.concat(fact, F.lit(", only through "), last)).otherwise(fact)
    parts = [F.lit('said: "'), said, F.lit('"\nfact: '), fact, F.lit("\nform: simple present\nobserved: "), written]
    return F.concat(*parts)


def writer_measures(sentence: Column, form: Column, record: Column) -> Column:
    """struct(verbatim, said_ing, fact_ing, form_correct) of a written record (map); texts are folded."""
    get = lambda k: F.coalesce(F.try_element_at(record, F.lit(k)), F.lit(""))
    label = F.lower(get("form"))
    progressive = F.contains(label, F.lit("progressive"))
    simple = F.contains(label, F.lit("simple present")) & ~progressive
    return F.struct(
        F.contains(F.lower(get("said")), F.regexp_replace(F.lower(sentence), r"\.+\z", "")).alias("verbatim"),
        has_ing_form(get("said")).alias("said_ing"),
        has_ing_form(get("fact")).alias("fact_ing"),
        F.when(form == "progressive", progressive).otherwise(simple).alias("form_correct"),
    )


def perturbed(text: Column, tokens: Column) -> Column:
    """map: edit -> text after it, for edits that must not change a label (of a folded text)."""
    edits = {
        "prepend-filler": F.concat(F.lit(P.FILLER), text),
        "curly-quotes": F.replace(text, F.lit("'"), F.lit("’")),
        "append-closer": F.concat(text, F.lit("\n\n" + P.CLOSER)),
        "bold-token": bold_tokens(text, tokens),
    }
    return F.create_map(*[x for name, edit in edits.items() for x in (F.lit(name), edit)])


def redated(text: Column, dates: list[tuple[str, str]], leftover: str) -> Column:
    """``dates``: (old, new) texts, replaced in order; null if ``leftover`` (a pattern) is still found."""
    out = reduce(lambda t, d: F.replace(t, F.lit(d[0]), F.lit(d[1])), dates, text)
    return F.when(~F.rlike(out, F.lit(leftover)), out)


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` stands in the text, from the left without overlap; 0 for an empty part."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, gone / F.length(part)).otherwise(0).cast("int")


def excerpt(text: Column, at: Column, before: int = 200, after: int = 300) -> Column:
    """The text around the place ``at`` (from 1)."""
    begin = F.greatest(at - before, F.lit(1))
    return F.substring(text, begin, at + after - begin)


def content_words(text: Column, stop: list[str]) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop)))


def article(noun: Column) -> Column:
    return F.when(F.lower(F.substring(noun, 1, 1)).isin("a", "e", "i", "o", "u"), "an").otherwise("a")


def fill(template: Column, values: dict[str, Column]) -> Column:
    """{name} parts replaced by columns."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def named(value: Column, use) -> Column:
    """``use`` of a value that is worked out once: a column that a lambda mentions is worked out at each mention, for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def field_records(text: Column) -> Column:
    """``key: value`` lines as an array of maps; a ``said`` line begins a new record once the current one holds anything."""
    found = F.filter(
        F.transform(
            lines(text),
            lambda s: F.struct(
                F.lower(F.regexp_extract(s, P.FLAGS + P.FIELD_LINE, 1)).alias("k"),
                F.trim(F.regexp_extract(s, P.FLAGS + P.FIELD_LINE, 2)).alias("v"),
            ),
        ),
        lambda p: p["k"] != "",
    )

    def record(own: Column) -> Column:
        keys = F.array_distinct(F.transform(own, lambda p: p["k"]))
        last = lambda k: F.element_at(F.filter(own, lambda p: p["k"] == k), -1)["v"]
        return F.map_from_arrays(keys, F.transform(keys, last))

    def records(pairs: Column) -> Column:
        # A record begins at the first line and at each later ``said``; of a key's lines in a record the last one counts.
        n = F.size(pairs)
        begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(pairs, i - 1)["k"] == "said"))
        owns = named(begins, lambda begins: F.transform(
            begins, lambda begin, i: F.slice(pairs, begin, F.coalesce(F.get(begins, i + 1), n + 1) - begin),
        ))
        return F.when(n > 0, F.transform(owns, record)).otherwise(F.array().cast("array<map<string,string>>"))

    return named(found, records)
