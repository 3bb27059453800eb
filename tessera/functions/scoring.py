"""Answer normalization and scoring as Column expressions.

All of these are built-in Spark expressions (regex, translate, higher-order
array functions), so they run inside whole-stage codegen without Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE

# Fixed values that must equal the reference's for the same results:
# ASCII punctuation removed by string normalization (Python string.punctuation).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Characters dropped before reading a number.
NUMBER_NOISE = "$%,"
# Separators of list answers.
LIST_SEPARATORS = "[,;]"
# Numbers inside free text: optional sign, thousands groups or digits, decimals.
NUMBER_PATTERN = r"-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
# Answers that count as no answer in majority voting.
NON_ANSWERS = ("Unable to determine", "None")

# What Python's float() accepts (H8): digits with single underscores between
# them, optional fraction and exponent, or inf/infinity/nan; outer whitespace.
_DIGITS = r"\d(?:_?\d)*"
FLOAT_PATTERN = (rf"^{WHITESPACE}*[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
                 rf"|(?i:inf|infinity|nan)){WHITESPACE}*$")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_float(s) -> Column:
    """would Python's ``float(s)`` succeed."""
    s = _c(s)
    return F.coalesce(s.rlike(FLOAT_PATTERN), F.lit(False))


def to_float(s) -> Column:
    """Python ``float(s)`` for strings accepted by ``is_float``, else null."""
    s = _c(s)
    return F.when(is_float(s), F.regexp_replace(s, f"_|{WHITESPACE}", "").try_cast("double"))


def normalize_number_str(s) -> Column:
    """drop ``$ % ,`` and read as a number; +inf when that fails."""
    cleaned = F.translate(_c(s), NUMBER_NOISE, "")
    return F.coalesce(to_float(cleaned), F.lit(float("inf")))


def split_string(s) -> Column:
    """split on ``,`` or ``;`` keeping empty pieces."""
    return F.split(_c(s), LIST_SEPARATORS, -1)


def normalize_str(s, remove_punct: bool = True) -> Column:
    """remove all whitespace, lower-case, optionally drop ASCII punctuation."""
    out = F.lower(F.regexp_replace(_c(s), WHITESPACE, ""))
    return F.translate(out, PUNCTUATION, "") if remove_punct else out


def question_scorer(model_answer, ground_truth) -> Column:
    """number, list (same length, element-wise number or string keeping
    punctuation) or string comparison, chosen by the shape of the truth."""
    ma, gt = _c(model_answer), _c(ground_truth)
    as_number = normalize_number_str(ma) == to_float(gt)
    g_el, m_el = split_string(gt), split_string(ma)
    elementwise = F.zip_with(g_el, m_el, lambda g, m: F.when(
        is_float(g), normalize_number_str(m) == to_float(g)
    ).otherwise(normalize_str(m, False) == normalize_str(g, False)))
    as_list = (F.size(g_el) == F.size(m_el)) & F.forall(elementwise, lambda x: F.coalesce(x, F.lit(False)))
    as_string = normalize_str(ma) == normalize_str(gt)
    return (F.when(is_float(gt), as_number)
            .when(gt.rlike(LIST_SEPARATORS), as_list)
            .otherwise(as_string))


def extract_numbers(text) -> Column:
    """all numbers in a text, thousands separators removed."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(NUMBER_PATTERN), 0),
                       lambda x: F.regexp_replace(x, ",", ""))


def math_scorer(answer, truth, rtol: float = 1e-5, atol: float = 1e-7) -> Column:
    """the last number of the answer is close to the truth
    (|a - b| <= atol + rtol * |b|); no number -> false."""
    nums = extract_numbers(answer)
    last = F.element_at(nums, -1).try_cast("double")
    b = to_float(_c(truth))
    close = F.abs(last - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.when(F.size(nums) == 0, F.lit(False)).otherwise(F.coalesce(close, F.lit(False)))


def letters_in_order(prediction, true_answer) -> Column:
    """Truth letters found in order in the prediction; a hit does not move
    the search start past itself; prediction longer than 3x truth -> false."""
    p, t = F.lower(_c(prediction)), F.lower(_c(true_answer))
    chars = F.split(t, "", -1)
    # locate() with a column start position needs the SQL function form
    pos = F.aggregate(chars, F.lit(1), lambda i, ch: F.when(i == 0, F.lit(0)).otherwise(
        F.call_function("locate", ch, p, i)))
    return (F.length(p) <= F.length(t) * 3) & ((F.length(t) == 0) | (pos > 0))


def close_call(prediction, true_answer, is_correct) -> Column:
    """F8: correct, or (non-numeric truth and) letters in order and
    0.5*len(truth) <= len(prediction) <= 2*len(truth)."""
    p, t = _c(prediction), _c(true_answer)
    near = (letters_in_order(p, t)
            & (F.length(p) >= F.length(t) * 0.5) & (F.length(p) <= F.length(t) * 2))
    return F.when(_c(is_correct), F.lit(True)).when(is_float(t), F.lit(False)).otherwise(near)


def answer_correct(answer, truth, source) -> Column:
    """Per-row correctness: MATH items use F7, the rest F5."""
    return F.when(_c(source) == "MATH", math_scorer(answer, truth)).otherwise(
        question_scorer(answer, truth))
