"""Text as column expressions: tags, templates, options, gold answers, and the extraction of answers from replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns. (?U) gives \s its Unicode meaning; \x1c-\x1f count as white space too.
S = r"[\s\x1c-\x1f]"
TAG = r"(?U)<[a-zA-Z]\d+,\s*CAM_[A-Z_]+,\s*[-\d.]+,\s*[-\d.]+>"
ANY_TAG = r"(?U)<[a-zA-Z]\d+,\s*CAM_[A-Z_]+,[^>]*>"
CAMERA = r"(?U)<[a-zA-Z]\d+,\s*(CAM_[A-Z_]+),"
OPTION = r"(?U)(?:^|(?<=[\s(\[]))([A-H])[.):\]]\s+"
LEAD = r"(?iU)(please\s+select\s+the\s+correct\s+answer\s+from\s+the\s+following\s+options\s*:?)"
ANSWER = r"(?iU)(?:final\s+answer|answer)\s*(?:is)?\s*[:\-]?\s*\(?\s*([A-H])\s*\)?\s*[.)\]]?"
BOXED = r"(?U)\\boxed\{\s*([A-H])\s*\}"
SOLE = r"(?U)^\s*\(?\s*([A-H])\s*\)?\s*[.):\]]?\s*$"
ALONE = r"(?U)(?:^|(?<=[\s(\[*]))([A-H])(?=[\s.):\]*,]|$)"
THINK = r"(?isU)<think>.*?</think>"
LINE_ENDS = r"\R|[\x1c-\x1e]"
PLACEHOLDER = "the referenced object"
LETTERS = "ABCDEFGH"
TAIL = 400

#: Surface patterns of questions, and of gold answers (these from the start).
PATTERNS = {
    "phrase_select_correct": r"(?i)select the correct answer",
    "phrase_following_options": r"(?i)following options",
    "word_options": r"(?i)\boptions?\b",
    "letter_dot_A": r"(?:^|\s)A\.\s",
    "letter_paren_A": r"(?:^|\s)\(?A\)\s",
    "letter_colon_A": r"(?:^|\s)A:\s",
    "two_letters_dot": r"(?s)(?:^|\s)A\.\s.*(?:^|\s)B\.\s",
    "newline_separated": r"\n\s*A[.):]",
}
GOLD_PATTERNS = {
    "answer_is_bare_letter": r"^\s*[A-H]\s*[.):\]]?\s*$",
    "answer_starts_with_letter": r"^\s*[A-H]\s*[.):\]]\s+\S",
}


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, rf"(?U)^{S}+|{S}+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){S}+", " ")


def strip_tags(c: Column) -> Column:
    """Object tags with coordinates become a phrase, and runs of white space one space."""
    return strip(F.regexp_replace(F.regexp_replace(c, TAG, PLACEHOLDER), rf"(?U){S}{{2,}}", " "))


def stem_for(condition: Column, stem: Column) -> Column:
    return F.when(condition == "blind_notags", strip_tags(stem)).otherwise(stem)


def template(c: Column) -> Column:
    """A question with its tags, of any form, as <OBJ>."""
    return strip(collapse(F.regexp_replace(F.coalesce(c, F.lit("")), ANY_TAG, "<OBJ>")))


def answer(c: Column) -> Column:
    return strip(F.regexp_replace(collapse(strip(F.coalesce(c, F.lit("")))), r"[ .]+$", ""))


def usable(c: Column, most: int = 60) -> Column:
    return (F.coalesce(c, F.lit("")) != "") & ~F.coalesce(c, F.lit("")).rlike(ANY_TAG) & (F.char_length(c) <= most)


def cameras(c: Column) -> Column:
    """Cameras of a stem's tags in the order of first mention, else the front one."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(CAMERA), 1))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("CAM_FRONT")))


def option_letters(k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.char((i + 65).cast("long")))


def options_block(letters: Column, texts: Column) -> Column:
    return F.array_join(F.zip_with(letters, texts, lambda a, b: F.concat(a, F.lit(". "), b)), "\n")


def counterbalanced(options: Column, gold: Column, rank: Column) -> Column:
    """``options`` with ``gold`` at place rank % k and the others around it in their order."""
    k = F.size(options)
    at = F.pmod(rank, k).cast("int")
    others = F.filter(options, lambda o: o != gold)
    return F.concat(F.slice(others, F.lit(1), at), F.array(gold), F.slice(others, at + 1, k))


def split_question(c: Column) -> Column:
    """struct<stem, letters, option_texts>; both arrays are empty where the text is no multiple choice.

    Options follow the lead phrase, if there is one. Their letters have to go A, B, C; what comes after the
    longest such beginning belongs to the last option, and fewer than two, or an empty option, make it none.
    """
    led = c.rlike(LEAD)
    whole = F.split(c, LEAD, 2)
    body = F.when(led, whole[1]).otherwise(c)
    marks = F.regexp_extract_all(body, F.lit(OPTION), 0)
    letters = F.transform(marks, lambda m: F.substring(m, 1, 1))
    parts = F.split(body, OPTION)
    wanted = F.transform(letters, lambda x, i: F.when(x == F.char((i + 65).cast("long")), True).otherwise(False))
    bad = F.array_position(wanted, F.lit(False))
    keep = F.when(bad == 0, F.size(letters)).otherwise(bad - 1).cast("int")
    # what lies after the last kept mark, marks and all
    texts = F.transform(F.sequence(F.lit(1), keep), lambda i: F.when(i < keep, F.get(parts, i)).otherwise(F.array_join(F.concat(F.array(F.get(parts, i)), F.flatten(F.transform(F.filter(F.sequence(i, F.size(marks)), lambda j: j > i), lambda j: F.array(F.get(marks, j - 1), F.get(parts, j))))), "")))
    clean = F.transform(texts, lambda t: F.regexp_replace(strip(t), r"[ .;,]+$", ""))
    ok = (keep >= 2) & ~F.exists(clean, lambda t: t == "")
    stem = strip(F.when(led, whole[0]).otherwise(parts[0]))
    none = F.expr("cast(array() as array<string>)")
    return F.struct(
        F.when(ok, stem).otherwise(strip(c)).alias("stem"),
        F.when(ok, F.slice(letters, F.lit(1), F.greatest(keep, F.lit(1)))).otherwise(none).alias("letters"),
        F.when(ok, clean).otherwise(none).alias("option_texts"),
    )


def folded(c: Column) -> Column:
    """Lower case, all but letters, digits and spaces deleted."""
    return strip(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))


def spaced(c: Column) -> Column:
    """Lower case, all but letters, digits and spaces made spaces, and these collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " "))


def gold_letter(c: Column, letters: Column, texts: Column) -> Column:
    """The letter that a gold answer means: a letter alone, one before a text, or that of the only option with its text; else null."""
    a = strip(c)
    alone = F.regexp_extract(a, rf"(?U)^([A-H])\s*[.):\]]?\s*$", 1)
    leading = F.regexp_extract(a, r"(?U)^([A-H])[.):\]]\s+", 1)
    target = folded(a)
    hits = F.filter(F.arrays_zip(letters.alias("l"), texts.alias("t")), lambda z: folded(z["t"]) == target)
    return F.when(F.array_contains(letters, alone), alone).when(F.array_contains(letters, leading), leading).when((target != "") & (F.size(hits) == 1), F.get(hits, 0)["l"])


def without_thinking(c: Column) -> Column:
    return F.regexp_replace(c, THINK, " ")


def thinking_chars(c: Column) -> Column:
    return F.aggregate(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(THINK), 0), F.lit(0), lambda n, b: n + F.char_length(b))


def _among(hits: Column, letters: Column) -> Column:
    return F.filter(F.transform(hits, lambda h: F.upper(h)), lambda h: F.array_contains(letters, h))


def extracted(c: Column, letters: Column, texts: Column) -> Column:
    """struct<letter, method, candidates> of a reply: the first method that gives a letter, from the strictest on.

    answer_tag (last in the last 400 characters), boxed (last), sole_letter, final_line, option_text, first_letter; several
    option texts or several letters are ambiguous; else unparseable. An empty or null reply is unparseable.
    """
    body = strip(without_thinking(c))
    tail = F.when(F.char_length(body) > TAIL, F.substring(body, -TAIL, TAIL)).otherwise(body)
    tagged = _among(F.regexp_extract_all(tail, F.lit(ANSWER), 1), letters)
    boxed = _among(F.regexp_extract_all(body, F.lit(BOXED), 1), letters)
    sole = F.regexp_extract(body, SOLE, 1)
    last = F.element_at(F.filter(F.transform(F.split(body, LINE_ENDS), strip), lambda x: x != ""), -1)
    final = F.regexp_extract(last, SOLE, 1)
    flat = spaced(body)
    by_text = F.transform(F.filter(F.arrays_zip(letters.alias("l"), texts.alias("t")), lambda z: (spaced(z["t"]) != "") & F.contains(flat, spaced(z["t"]))), lambda z: z["l"])
    alone = F.array_sort(F.array_distinct(_among(F.regexp_extract_all(body, F.lit(ALONE), 1), letters)))
    none = F.expr("cast(array() as array<string>)")

    def found(letter: Column, method: str, candidates: Column = none) -> Column:
        return F.struct(letter.cast("string").alias("letter"), F.lit(method).alias("method"), candidates.alias("candidates"))

    nothing = found(F.lit(None), "unparseable")
    return (
        F.when(F.coalesce(body, F.lit("")) == "", nothing)
        .when(F.size(tagged) > 0, found(F.get(tagged, F.size(tagged) - 1), "answer_tag"))
        .when(F.size(boxed) > 0, found(F.get(boxed, F.size(boxed) - 1), "boxed"))
        .when(F.array_contains(letters, sole), found(sole, "sole_letter"))
        .when(F.array_contains(letters, final), found(final, "final_line"))
        .when(F.size(by_text) == 1, found(F.get(by_text, 0), "option_text"))
        .when(F.size(by_text) > 1, found(F.lit(None), "ambiguous", F.array_sort(F.array_distinct(by_text))))
        .when(F.size(alone) == 1, found(F.get(alone, 0), "first_letter"))
        .when(F.size(alone) > 1, found(F.lit(None), "ambiguous", alone))
        .otherwise(nothing)
    )


def length_bucket(n: Column) -> Column:
    out = F.when(n < 50, "<50")
    for edge in (100, 200, 400, 800):
        out = out.when(n < edge, f"<{edge}")
    return out.otherwise(">=800")


def terminal_reason(status: Column, body: Column) -> Column:
    """Why a call failed for good; the body's words count before the status."""
    low = F.lower(F.coalesce(body, F.lit("")))
    has = lambda w: F.contains(low, F.lit(w))
    return (
        F.when(has("context") & (has("length") | has("window")), "context_overflow")
        .when(has("content") & (has("filter") | has("policy")), "content_refusal")
        .when(status.isin(401, 403), "auth")
        .when(status == 404, "unknown_model")
        .otherwise(F.concat(F.lit("http_"), status.cast("string")))
    )
