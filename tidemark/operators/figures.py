"""Texts of charts, images and formulas for an index, and whether they need a check by a reader.

Each function takes columns and gives struct(origin, text, unverified, reason); text is null where there is
nothing to index. What comes from the document itself never needs a check; a text that holds a model's
description counts as derived, and an unsure one stays as a lead without its values. Null arrays count as
empty, null or blank texts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.workbench import VISION_LEAST

#: Labels of the parts of a text (fixed values).
LEGEND, AXIS, UNIT, FOOTNOTE, FORMULA, VARIABLES, VALUES, DERIVED = "图例：", "坐标轴：", "单位：", "脚注：", "公式：", "变量：", "数值：", "（模型派生描述）"
#: Separators of names, of values, and of a symbol from its meaning (fixed values).
NAMES_BY, VALUES_BY, MEANS = "、", "；", " — "
#: The origin of what holds a model's description.
VISION = "VISION_DERIVED"


def _said(text: Column) -> Column:
    """text without blanks around it, null where nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def _listed(label: str, items: Column, by: str) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, by)))


def _labelled(label: str, text: Column) -> Column:
    return F.concat(F.lit(label), F.nullif(text, F.lit("")))


def doubt(confidence: Column, values: Column, series: Column) -> Column:
    """Why a model's description is no evidence, '' where it is: UNSURE, then NO_NUMBER (a value without a digit), then NO_SERIES (values that belong to nothing)."""
    bad = F.exists(values, lambda v: ~F.coalesce(v.rlike("[0-9]"), F.lit(False)))
    nameless = (F.size(values) > 0) & ~F.coalesce(F.size(series) > 0, F.lit(False))
    sure = F.coalesce(confidence >= VISION_LEAST, F.lit(False))
    return F.when(~sure, "UNSURE").when(bad, "NO_NUMBER").when(nameless, "NO_SERIES").otherwise("")


def _described(vision: Column, why: Column) -> Column:
    values = F.when(why == "", _listed(VALUES, vision["values"], VALUES_BY))
    return F.concat_ws("\n", F.concat(F.lit(DERIVED), vision["description"]), values)


def _block(origin: Column, text: Column, unverified: Column, reason: Column) -> Column:
    return F.struct(origin.alias("origin"), text.alias("text"), unverified.alias("unverified"), reason.alias("reason"))


def chart(origin: Column, caption: Column, legend: Column, axes: Column, unit: Column, footnote: Column, nearby: Column, vision: Column) -> Column:
    """The document's own layer, then what a model saw. axes: array of struct(label, unit); vision: struct(description, confidence, values, series) or null."""
    axis = F.transform(axes, lambda a: F.concat(F.lit(AXIS), a["label"], F.coalesce(F.concat(F.lit("（"), F.nullif(a["unit"], F.lit("")), F.lit("）")), F.lit(""))))
    own = F.concat_ws("\n", _said(caption), _listed(LEGEND, legend, NAMES_BY), axis, _labelled(UNIT, unit), _labelled(FOOTNOTE, footnote), _said(nearby))
    own = F.nullif(own, F.lit(""))
    why = doubt(vision["confidence"], vision["values"], vision["series"])
    alone = _block(origin, own, F.lit(False), F.when(own.isNull(), "NO_SOURCE").otherwise(""))
    return F.when(vision.isNull(), alone).otherwise(_block(F.lit(VISION), F.concat_ws("\n", own, _described(vision, why)), why != "", why))


def image(origin: Column, caption: Column, decorative: Column, vision: Column) -> Column:
    """Null for a decorative image, which leaves nothing; its caption, else what a model saw, else no text."""
    why = doubt(vision["confidence"], vision["values"], vision["series"])
    nothing = _block(origin, F.lit(None).cast("string"), F.lit(False), F.lit("NO_SOURCE"))
    seen = F.when(_said(caption).isNotNull(), _block(origin, _said(caption), F.lit(False), F.lit("")))
    seen = seen.when(vision.isNotNull(), _block(F.lit(VISION), _described(vision, why), why != "", why)).otherwise(nothing)
    return F.when(~F.coalesce(decorative, F.lit(False)), seen)


def formula(origin: Column, name: Column, expression: Column, variables: Column, context: Column) -> Column:
    """Name, expression as written, variables (array of struct(symbol, meaning)) and context; without an expression no text, as none is guessed."""
    named = _listed(VARIABLES, F.transform(variables, lambda v: F.concat(v["symbol"], F.lit(MEANS), v["meaning"])), VALUES_BY)
    text = F.concat_ws("\n", _labelled(FORMULA, name), expression, named, F.nullif(context, F.lit("")))
    return _block(origin, F.when(expression.isNotNull(), text), F.lit(False), F.when(expression.isNull(), "NOT_RECOGNISED").otherwise(""))
