"""Text columns: cleaning, question rules, label calibration, ensemble, confidence, label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ensemble weights, in the order model, lexicon, question, vader, text classifier.
ENSEMBLE_WEIGHTS = (0.40, 0.35, 0.15, 0.05, 0.05)
CONFIDENCE_THRESHOLD = 0.40
MODEL_THRESHOLD = 0.6


# White space of Unicode.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def full_text(headline: Column, body: Column) -> Column:
    """Headline and body joined by one space; NULL when there is nothing to score."""
    joined = strip(F.concat_ws(" ", headline, F.coalesce(body, F.lit(""))))
    return F.when(headline.isNotNull() & (joined != ""), joined)


def plain_words(col: Column) -> Column:
    """Lower case with punctuation as blanks, the input of the text classifier."""
    return F.regexp_replace(F.lower(col), r"(?U)[^\w\s]", " ")


def tokens(col: Column) -> Column:
    """All words of the lower-cased text, with repeats."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"(?U)(\w+)"), F.lit(1))


def clamp(col: Column, low: float, high: float) -> Column:
    """Clamp a number; NULL stays NULL."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def _any(text: Column, *needles: str) -> Column:
    found = text.contains(needles[0])
    for needle in needles[1:]:
        found = found | text.contains(needle)
    return found


def _modal_then(text: Column, modals: Sequence[str], moves: Sequence[str]) -> Column:
    """A modal followed by a move on the same line.

    The first modal of a line ends before any later one, so an atomic match of it is enough and the
    search stays linear in the length of the line.
    """
    pattern = rf"(?md)^(?>.*?(?:{'|'.join(modals)})).*(?:{'|'.join(moves)})"
    return _any(text, *moves) & text.rlike(pattern)


def question_bias(text: Column) -> Column:
    """Bias of question-like headlines; the first rule that fires decides."""
    t = F.lower(text)
    # Phrases and scores, in order of precedence.
    return (
        F.when(t.isNull(), F.lit(0.0))
        .when(_any(t, "before buying", "before you buy"), F.lit(-0.2))
        .when(_any(t, "what to know"), F.lit(0.0))
        .when(_any(t, "once-in-a-decade", "once in a decade"), F.lit(0.6))
        .when(_any(t, "buying opportunity"), F.lit(0.5))
        .when(_modal_then(t, ("can", "will", "could"), ("reach", "hit", "surge", "soar", "climb")), F.lit(0.4))
        .when(_modal_then(t, ("can", "will", "could"), ("keep running", "keep rising", "outperform")), F.lit(0.4))
        .when(_modal_then(t, ("could", "will"), ("heading higher", "go higher", "rise")), F.lit(0.3))
        .when(_any(t, "best") & _any(t, "buy", "stock"), F.lit(0.4))
        .when(_any(t, "overlooked", "undervalued"), F.lit(0.3))
        .when(_any(t, "should you avoid", "don't buy"), F.lit(-0.5))
        .when(_any(t, "overvalued", "bubble"), F.lit(-0.4))
        .otherwise(F.lit(0.0))
    )


def calibrate(label: Column, confidence: Column) -> Column:
    """Three-way classifier output to [-1, 1]; unsure neutrals lean slightly positive."""
    name = F.lower(label)
    return (
        F.when(name.contains("positive"), confidence)
        .when(name.contains("negative"), -confidence)
        .when(confidence < 0.7, F.lit(0.15))
        .when(confidence < 0.85, F.lit(0.05))
        .otherwise(F.lit(0.0))
    )


def combine(
    model: Column, lexicon: Column, question: Column, vader: Column, classifier: Column,
    weights: Sequence[float] = ENSEMBLE_WEIGHTS,
) -> Column:
    """Weighted ensemble in [-1, 1]."""
    parts = (model, lexicon, question, vader, classifier)
    total = parts[0] * weights[0]
    for part, weight in zip(parts[1:], weights[1:]):
        total = total + part * weight
    return clamp(total, -1.0, 1.0)


def agreement(scores: Sequence[Column], extra: Column, use_extra: Column) -> Column:
    """1 minus the normalised population deviation of the scores, `extra` counted only if `use_extra`."""
    n = F.lit(float(len(scores))) + use_extra.cast("double")
    kept = F.when(use_extra, extra).otherwise(0.0)
    mean = (sum(scores[1:], scores[0]) + kept) / n
    squares = sum([(s - mean) * (s - mean) for s in scores], F.lit(0.0))
    squares = squares + F.when(use_extra, (extra - mean) * (extra - mean)).otherwise(0.0)
    # Fixed value: largest deviation expected for scores in [-1, 1].
    return F.lit(1.0) - F.least(F.sqrt(squares / n) / 0.816, F.lit(1.0))


def confidence(combined: Column, model: Column, lexicon: Column, vader: Column, question: Column) -> Column:
    """Confidence in [0, 1]: agreement, magnitude, bonuses for strong hits, penalty when all are weak."""
    asked = F.abs(question) > 0.1
    strongest = F.greatest(F.abs(model), F.abs(lexicon), F.abs(vader), F.when(asked, F.abs(question)).otherwise(0.0))
    score = (
        agreement((model, lexicon, vader), question, asked) * 0.30
        + F.abs(combined) * 0.35
        + F.when(F.abs(lexicon) > 0.8, 0.15).otherwise(0.0)
        + F.when(F.abs(question) > 0.3, 0.10).otherwise(0.0)
    ) * F.when(strongest >= 0.15, 1.0).otherwise(0.5)
    return clamp(score, 0.0, 1.0)


def signal_label(conf: Column, combined: Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    """Signal or Noise; strong sentiment passes a lower bar."""
    # 0.40 - 0.05 is not exactly 0.35 in binary, so the difference is kept as it is computed.
    eased = max(0.35, threshold - 0.05)
    bar = F.when(F.abs(combined) > 0.45, F.lit(eased)).otherwise(F.lit(threshold))
    return F.when(conf.isNotNull(), F.when(conf >= bar, "Signal").otherwise("Noise"))


def model_label(probability: Column, threshold: float = MODEL_THRESHOLD) -> Column:
    """Signal or Noise from a model probability."""
    return F.when(probability.isNotNull(), F.when(probability > threshold, "Signal").otherwise("Noise"))


def centred_probability(probability: Column) -> Column:
    """Probability of the positive class as a score in [-1, 1]."""
    return (probability - 0.5) * 2
