"""The value of arithmetic texts as a column expression: a fold over the tokens of each text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers, and the signs of sums.
TOKEN = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[-+*/()]"

#: What the fold holds: sums and products begun outside of open brackets, and those of the innermost one. acc: sum of the
#: finished terms; term: the product so far; div: the next value divides; sign: of the next value; ready: a value stands
#: before this place.
STATE = "struct<stack:array<struct<acc:double,term:double,div:boolean,sign:double>>,acc:double,term:double,div:boolean,sign:double,ready:boolean,bad:boolean>"


def sum_value(text: Column) -> Column:
    """The value of an expression of numbers, + - * /, signs and brackets, however deep; null for anything else, and for a
    division by zero or an overflow. Products bind tighter than sums, equal signs go from the left."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    clean = F.regexp_replace(text, r"\s", "")
    whole = F.array_join(tokens, "") == clean
    empty = F.array().cast("array<struct<acc:double,term:double,div:boolean,sign:double>>")

    def state(stack, acc, term, div, sign, ready, bad):
        parts = {"stack": stack, "acc": acc, "term": term, "div": div, "sign": sign, "ready": ready, "bad": bad}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in parts.items()])

    def times(held: Column, value: Column) -> Column:
        signed = held["sign"] * value
        return F.when(held["div"], F.try_divide(held["term"], signed)).otherwise(held["term"] * signed)

    def step(s: Column, t: Column) -> Column:
        number = t.try_cast("double")
        top = F.element_at(s["stack"], -1)
        wrong = state(s["stack"], s["acc"], s["term"], s["div"], s["sign"], s["ready"], True)
        value = state(s["stack"], s["acc"], times(s, number), False, 1.0, True, s["bad"])
        here = F.struct(s["acc"].alias("acc"), s["term"].alias("term"), s["div"].alias("div"), s["sign"].alias("sign"))
        opened = state(F.array_append(s["stack"], here), 0.0, 1.0, False, 1.0, False, s["bad"])
        rest = F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)
        closed = state(rest, top["acc"], times(top, s["acc"] + s["term"]), False, 1.0, True, s["bad"])
        added = state(s["stack"], s["acc"] + s["term"], F.when(t == "-", -1.0).otherwise(1.0), False, 1.0, False, s["bad"])
        scaled = state(s["stack"], s["acc"], s["term"], t == "/", 1.0, False, s["bad"])
        signed = state(s["stack"], s["acc"], s["term"], s["div"], F.when(t == "-", -s["sign"]).otherwise(s["sign"]), False, s["bad"])
        plus = t.isin("+", "-")
        out = (
            F.when(s["bad"], wrong).when(number.isNotNull(), F.when(s["ready"], wrong).otherwise(value)).when(t == "(", F.when(s["ready"], wrong).otherwise(opened))
            .when(t == ")", F.when(s["ready"] & (F.size(s["stack"]) > 0), closed).otherwise(wrong)).when(s["ready"], F.when(plus, added).otherwise(scaled)).when(plus, signed).otherwise(wrong)
        )
        return out.cast(STATE)

    def result(s: Column) -> Column:
        value = s["acc"] + s["term"]
        return F.when(~s["bad"] & s["ready"] & (F.size(s["stack"]) == 0) & (F.abs(value) < float("inf")), value)

    return F.when(whole & (clean != ""), F.aggregate(tokens, state(empty, 0.0, 1.0, False, 1.0, False, False).cast(STATE), step, result))
