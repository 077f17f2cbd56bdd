"""Scalar functions as column expressions, and the recursive ones as Arrow UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: User agents of crawlers.
CRAWLERS = "Googlebot Bingbot Slurp DuckDuckBot Baiduspider YandexBot Sogou Exabot facebot facebookexternalhit ia_archiver DotBot SemrushBot AhrefsBot".split()
#: Primitive types of methods' parameters.
PRIMITIVES = "boolean byte char short int long float double void".split()
#: Access bits and their names, by what they stand on.
METHOD_FLAGS = {0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x20: "synchronized", 0x100: "native", 0x400: "abstract", 0x800: "strict"}
CLASS_FLAGS = {0x1: "public", 0x10: "final", 0x20: "super", 0x200: "interface", 0x400: "abstract", 0x1000: "synthetic", 0x2000: "annotation", 0x4000: "enum", 0x8000: "module"}
FIELD_FLAGS = {0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x40: "volatile", 0x80: "transient", 0x1000: "synthetic", 0x4000: "enum"}
MODULE_FLAGS = {0x20: "open", 0x1000: "synthetic", 0x8000: "mandated"}
FLAGS = {"method": METHOD_FLAGS, "class": CLASS_FLAGS, "field": FIELD_FLAGS, "module": MODULE_FLAGS}
#: Instructions in the order of their codes; braces stand for each letter, word or number in them.
INSTRUCTIONS = """nop aconst_null iconst_m1 iconst_{0-5} lconst_{0-1} fconst_{0-2} dconst_{0-1} bipush sipush ldc ldc_w ldc2_w
{ilfda}load {ilfda}load_{0-3} {ilfdabcs}aload {ilfda}store {ilfda}store_{0-3} {ilfdabcs}astore pop pop2 dup dup_x1 dup_x2 dup2 dup2_x1 dup2_x2 swap
{ilfd}add {ilfd}sub {ilfd}mul {ilfd}div {ilfd}rem {ilfd}neg {il}shl {il}shr {il}ushr {il}and {il}or {il}xor iinc
i2l i2f i2d l2i l2f l2d f2i f2l f2d d2i d2l d2f i2b i2c i2s lcmp fcmpl fcmpg dcmpl dcmpg if{eq,ne,lt,ge,gt,le} if_icmp{eq,ne,lt,ge,gt,le} if_acmp{eq,ne}
goto jsr ret tableswitch lookupswitch {ilfda}return return getstatic putstatic getfield putfield invokevirtual invokespecial invokestatic invokeinterface invokedynamic
new newarray anewarray arraylength athrow checkcast instanceof monitorenter monitorexit wide multianewarray ifnull ifnonnull goto_w jsr_w"""
#: Descriptor letters.
LETTERS = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def is_crawler(agent: Column) -> Column:
    """An empty or missing agent is no crawler."""
    return F.coalesce(agent.rlike("|".join(CRAWLERS)), F.lit(False))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of an offset, from 0."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def member_name(name: Column) -> Column:
    """a.b.c -> a.b#c, unless a # is there."""
    return F.when(name.contains("#"), name).otherwise(F.regexp_replace(name, r"\.([^.]*)$", "#$1"))


def method_pattern(term: Column) -> Column:
    """The ILIKE pattern of a method search `name(parameter, ...)`; wildcards of the user stay live."""
    name = member_name(F.substring_index(term, "(", 1))
    name = F.when(name.contains("."), name).otherwise(F.concat(F.lit("%."), name))
    inner = F.regexp_replace(F.substring(term, F.instr(term, "(") + 1, F.length(term)), r"\)$", "")
    one = lambda p: F.when(p == "*", "%").when(p.contains(".") | F.lower(p).isin(PRIMITIVES), p).otherwise(F.concat(F.lit("%."), p))
    return F.concat(name, F.lit("("), F.array_join(F.transform(F.split(inner, ","), lambda p: one(F.trim(p))), ","), F.lit(")"))


def mnemonics() -> list[str]:
    """The instruction of each code, from 0."""

    def expanded(name: str) -> list[str]:
        head, _, rest = name.partition("{")
        if not rest:
            return [name]
        inner, _, tail = rest.partition("}")
        each = inner.split(",") if "," in inner else [str(i) for i in range(int(inner[0]), int(inner[-1]) + 1)] if "-" in inner else list(inner)
        return [head + e + t for e in each for t in expanded(tail)]

    return [m for name in INSTRUCTIONS.split() for m in expanded(name)]


def mnemonic(code: Column) -> Column:
    """The instruction of a code; null if there is none."""
    return F.get(F.array(*[F.lit(m) for m in mnemonics()]), code.cast("int"))


def flags(bits: Column, target: str = "method") -> Column:
    """Names of the access bits that are set on a method, class, field or module."""
    pairs = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(n).alias("name")) for b, n in FLAGS[target].items()])
    return F.transform(F.filter(pairs, lambda x: bits.bitwiseAND(x["bit"]) != 0), lambda x: x["name"])


def parse_type(s: str, i: int = 0) -> tuple[str, int]:
    """A type of a descriptor or generic signature, and where it ends."""
    if s[i] == "[":
        name, i = parse_type(s, i + 1)
        return name + "[]", i
    if s[i] == "T":
        end = s.index(";", i)
        return s[i + 1 : end], end + 1
    if s[i] != "L":
        return LETTERS[s[i]], i + 1
    name, i = "", i + 1
    while s[i] != ";":
        if s[i] == "<":
            i, args = i + 1, []
            while s[i] != ">":
                if s[i] == "*":
                    args.append("?")
                    i += 1
                    continue
                bound = {"+": "? extends ", "-": "? super "}.get(s[i], "")
                arg, i = parse_type(s, i + bool(bound))
                args.append(bound + arg)
            name += f"<{', '.join(args)}>"
            i += 1
        else:
            name += {"/": ".", "$": "."}.get(s[i], s[i])
            i += 1
    return name, i + 1


def pretty_method(signature: str | None, name: str) -> str | None:
    """A generic method signature as source text."""
    if signature is None:
        return None
    i, params = 0, []
    if signature[0] == "<":
        i = 1
        while signature[i] != ">":
            colon = signature.index(":", i)
            variable, bounds, i = signature[i:colon], [], colon
            while signature[i] == ":":
                if signature[i + 1] == ":":
                    i += 1
                    continue
                bound, i = parse_type(signature, i + 1)
                if bound != "java.lang.Object":
                    bounds.append(bound)
            params.append(variable + (" extends " + " & ".join(bounds) if bounds else ""))
        i += 1
    i, args = i + 1, []
    while signature[i] != ")":
        arg, i = parse_type(signature, i)
        args.append(arg)
    result, i = parse_type(signature, i + 1)
    thrown = []
    while i < len(signature):
        one, i = parse_type(signature, i + 1)
        thrown.append(one)
    head = f"<{', '.join(params)}> " if params else ""
    return f"{head}{result} {name}({', '.join(args)})" + (f" throws {', '.join(thrown)}" if thrown else "")


@F.pandas_udf(StringType())
def pretty_method_udf(signature: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([pretty_method(s, n) for s, n in zip(signature, name, strict=True)], dtype=object)
