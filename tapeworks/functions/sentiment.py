"""Sentiment of finance texts by phrases.  All functions are expressions on columns; a list of
many phrases is looked for in one walk over the text (:mod:`.phrases`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .phrases import holds_any, phrases_met, weight_met

# Phrases and weights.
LEXICON = {
    "missed expectations": -0.7, "slowed growth": -0.5, "lawsuit": -0.8, "recall": -0.9, "downgrade": -0.7, "volatility": -0.4,
    "regulatory": -0.4, "uncertain": -0.4, "decline": -0.6, "losses": -0.8, "deficit": -0.7, "bankruptcy": -1.0, "investigation": -0.8,
    "fraud": -1.0, "scandal": -0.9, "crisis": -0.8, "emergency": -0.7, "warning": -0.6, "alert": -0.5, "concern": -0.5, "worry": -0.6,
    "risk": -0.5, "threat": -0.7, "challenge": -0.4, "problem": -0.6, "issue": -0.4, "difficulty": -0.5, "struggle": -0.6,
    "pressure": -0.5, "weakness": -0.6, "shortfall": -0.7, "disappointing": -0.6, "underperform": -0.7, "deteriorating": -0.7,
    "weakening": -0.6, "falling": -0.5, "dropping": -0.5, "plummeting": -0.8, "crashing": -0.9, "collapsing": -0.9,
    "rightsizing": -0.7, "optimization": -0.4, "restructuring": -0.5, "streamlining": -0.4, "synergies": -0.3, "efficiency": -0.2,
    "strategic pivot": -0.4, "realignment": -0.3, "transformation": -0.3,
    "beat expectations": 0.8, "exceeded": 0.7, "growth": 0.5, "profit": 0.6, "revenue": 0.4, "earnings": 0.4, "dividend": 0.5,
    "expansion": 0.6, "acquisition": 0.4, "merger": 0.3, "partnership": 0.4, "innovation": 0.5, "breakthrough": 0.7, "success": 0.6,
    "achievement": 0.5, "milestone": 0.5, "record high": 0.8, "strong": 0.5, "robust": 0.6, "solid": 0.4, "outstanding": 0.7,
    "excellent": 0.7, "upgrade": 0.6, "buy rating": 0.7, "outperform": 0.6, "bullish": 0.6, "positive": 0.4, "optimistic": 0.5,
    "confidence": 0.5, "momentum": 0.4, "rally": 0.6, "surge": 0.7, "soar": 0.8, "spike": 0.6, "jump": 0.5, "gain": 0.4, "rise": 0.4,
    "increase": 0.3, "improvement": 0.5, "recover": 0.5, "rebound": 0.6,
    "jumps": 0.5, "rises": 0.4, "gains": 0.4, "surges": 0.7, "spikes": 0.6, "soars": 0.8, "climbs": 0.4, "advances": 0.4, "up": 0.3,
    "higher": 0.3, "after hours": 0.2, "trading": 0.1, "volume": 0.1, "breakout": 0.6, "bullish momentum": 0.7,
    "strong performance": 0.6, "beats estimates": 0.8, "exceeds expectations": 0.8,
}
# Boost terms by strength.
BOOSTS = (
    (0.5, ("soar", "surge", "spike", "rally", "breakout", "moon", "explode")),
    (-0.5, ("crash", "plunge", "collapse", "tank", "plummet", "nosedive")),
    (0.3, ("jump", "rise", "gain", "up", "climb", "advance", "higher", "beat", "exceed")),
    (-0.3, ("fall", "drop", "decline", "sink", "slide", "slip", "tumble")),
    (0.15, ("increase", "grow", "improve", "recover", "$", "buy", "bullish")),
    (-0.15, ("down", "lower", "weak", "miss", "disappoint", "concern", "risk")),
)
# Either-or contexts (weight, terms of the first kind, terms of the second).
TRADES = (0.1, ("acquired", "buys", "increases position", "adds"), ("sells", "reduces", "exits", "dumps"))
EARNINGS = (0.4, ("beat", "exceed", "strong", "solid"), ("miss", "weak", "disappointing"))
DOLLARS = (0.2, ("jump", "gain", "rise", "up"), ("drop", "fall", "down", "loss"))
MODEL_DOLLARS = (0.3, ("jump", "gain", "rise", "up", "surge"), ("drop", "fall", "down", "loss", "decline"))
# What a model's boost makes of the strengths above.
MODEL_SCALE = {0.5: 0.4, -0.5: -0.4, 0.3: 0.25, -0.3: -0.25}
# Weights of strong and moderate phrases in titles, the most that they give, and compound for each point of polarity.
TITLE_STRONG, TITLE_MODERATE, TITLE_MOST, TITLE_CONFIDENCE = 0.7, 0.4, 0.8, 0.9
# Phrases in titles.
TITLE_STRONG_NEGATIVE = (
    "pulled down", "falls", "drops", "plunges", "crashes", "faces", "downgrade", "cut", "worst-performing", "slips", "declines",
    "tumbles", "sinks", "probe", "investigates", "challenges", "struggles", "disappoints", "misses", "below expectations", "concerns",
    "risks", "losses", "credit rating downgrade", "expenses soar", "cost surge",
)
TITLE_STRONG_POSITIVE = (
    "no-brainer", "soars", "surging", "rallies", "climbs", "gains", "jumps", "beats", "outperforms", "buy recommendation", "buy rating",
    "overweight", "bullish", "attractive entry", "path to", "double from here", "upside", "optimism",
)
TITLE_NEGATIVE = ("waiting for turnaround", "held back", "insufficient growth", "mixed signals", "uncertainties", "longer turnaround", "shenanigans")
TITLE_POSITIVE = ("analysts see", "as a buy", "wall street stays bullish", "comeback", "stabilized", "buffett", "investing", "attractive", "potential upside")
CONSENT = ("click 'accept all'", "consent framework", "sign in to access", "stock quote", "marketwatch")


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def clamp(value: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), value))


def _all(*groups: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(p for group in groups for p in group))


_TITLES = _all(TITLE_STRONG_NEGATIVE, TITLE_STRONG_POSITIVE, TITLE_NEGATIVE, TITLE_POSITIVE)
_TERMS = _all(*(terms for _, terms in BOOSTS), *TRADES[1:], *EARNINGS[1:], *DOLLARS[1:], *MODEL_DOLLARS[1:], ("earnings",))


def title_score(title: Column) -> tuple[Column, Column]:
    """Polarity and compound of a title; moderate phrases count where strong ones are lacking or cancel."""
    met = phrases_met(F.lower(title), _TITLES)
    hit = lambda phrases, w: F.when(holds_any(met, _TITLES, phrases), F.lit(w)).otherwise(0.0)
    strong = hit(TITLE_STRONG_NEGATIVE, -TITLE_STRONG) + hit(TITLE_STRONG_POSITIVE, TITLE_STRONG)
    moderate = hit(TITLE_NEGATIVE, -TITLE_MODERATE) + hit(TITLE_POSITIVE, TITLE_MODERATE)
    polarity = clamp(F.when(F.abs(strong) >= 0.1, strong).otherwise(moderate), TITLE_MOST)
    return polarity, polarity * TITLE_CONFIDENCE


def lexicon_score(text: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    """0.8 of the weight of each phrase that the lower-cased text contains, all found in one walk."""
    return weight_met(phrases_met(F.lower(text), tuple(lexicon)), [w * 0.8 for w in lexicon.values()])


def _weighted(met: Column, groups) -> Column:
    """Weights of the terms ``met`` (a word holds a term where the text does, for terms hold no space)."""
    weights = dict.fromkeys(_TERMS, 0.0)
    for weight, terms in groups:
        for term in terms:
            weights[term] += weight
    return weight_met(met, list(weights.values()))


def _either(met: Column, rule, when: Column = None) -> Column:
    weight, good, bad = rule
    out = F.when(holds_any(met, _TERMS, good), weight).when(holds_any(met, _TERMS, bad), -weight).otherwise(0.0)
    return out if when is None else F.when(when, out).otherwise(0.0)


def boost_score(text: Column) -> Column:
    """Boost words, trades of institutions, earnings, a percentage over 2, dollar amounts."""
    t = F.lower(text)
    met = phrases_met(t, _TERMS)
    percent = F.regexp_extract(t, r"([0-9]+([.][0-9]+)?)%", 1).try_cast("double")
    dollars = t.rlike(r"[$][0-9]+")
    return _weighted(met, BOOSTS) + _either(met, TRADES) + _either(met, EARNINGS, holds_any(met, _TERMS, ("earnings",))) + F.when(percent > 2, 0.3).otherwise(0.0) + _either(met, DOLLARS, dollars)


def combine_lexicon(base: Column, subjectivity: Column, adjustment: Column) -> tuple[Column, Column]:
    """Polarity and compound from a base polarity and the finance adjustment."""
    polarity = clamp(F.when((F.abs(base) < 0.1) & (F.abs(adjustment) > 0.1), adjustment * 1.5).otherwise(base + adjustment), 1.0)
    return polarity, polarity * subjectivity


def model_boost(text: Column) -> Column:
    t = F.lower(text)
    met = phrases_met(t, _TERMS)
    return _weighted(met, [(MODEL_SCALE[w], terms) for w, terms in BOOSTS if w in MODEL_SCALE]) + _either(met, MODEL_DOLLARS, t.rlike(r"[$][0-9]+"))


def calibrate(label: Column, score: Column, text: Column) -> tuple[Column, Column]:
    """Polarity and compound from a model's label and score and the finance terms."""
    sign = F.when(F.contains(F.lower(label), F.lit("positive")), 1.0).when(F.contains(F.lower(label), F.lit("negative")), -1.0).otherwise(0.0)
    boost = model_boost(text)
    override = F.contains(F.lower(label), F.lit("neutral")) & (F.abs(boost) > 0.2)
    polarity = F.when(override, boost).otherwise(sign * score * 0.8 + boost * 0.5)
    compound = F.when(override, boost).otherwise(sign * score + boost * 0.3)
    return clamp(polarity, 1.0), clamp(compound, 1.0)


def sentiment_label(compound: Column) -> Column:
    """Label of an article; from -0.05 to 0.05 is Neutral."""
    return F.when(compound > 0.75, "Very Positive").when(compound > 0.05, "Positive").when(compound < -0.75, "Very Negative").when(compound < -0.05, "Negative").otherwise("Neutral")


def overall_label(average: Column) -> Column:
    return F.when(average > 0.1, "Very Positive").when(average > 0.01, "Positive").when(average < -0.1, "Very Negative").when(average < -0.01, "Negative").otherwise("Neutral")
