"""Declared schemas of every relation. Nothing in the package infers one."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B, _D = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()
_AS = T.ArrayType(_S)


def _st(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FILES = _st(repo=_S, path=_S, content=T.BinaryType())

CALL = _st(simple=_S, display=_S)
DEFINITION = _st(qualname=_S, name=_S, kind=_S, pos=_I, start_line=_I, end_line=_I,
                 docstring=_S, source=_S, owner_class=_S, calls=T.ArrayType(CALL),
                 bases=_AS, params=_AS, exported=_B)
#: Of a definition, what tells its names: the same fields, none of its text.
NAMED = _st(qualname=_S, pos=_I, start_line=_I, end_line=_I, params=_AS)
NAMES = _st(defs=T.ArrayType(NAMED), attributes=_AS)
PARSED = _st(defs=T.ArrayType(DEFINITION), attributes=_AS, error=_S)

EDGES = _st(repo=_S, caller=_S, callee=_S)
CLAIM = _st(type=_S, subject=_S, object=_S, quote=_S)
CLAIMS = _st(repo=_S, claim_id=_S, section_key=_S, ord=_I, type=_S, subject=_S,
             object=_S, quote=_S)
CLAIM_REPLY = _st(claims=T.ArrayType(CLAIM))

SECTION = _st(key=_S, heading=_S, body=_S, kind=_S, allowed=_AS, attempts=_I)
DRAFT = _st(repo=_S, model=_S, sections=T.ArrayType(SECTION))

NOTE = _st(qualname=_S, file=_S, start_line=_I, end_line=_I, kind=_S, role=_S, score=_D,
           fan_in=T.LongType(), fan_out=T.LongType(), purpose=_S, inputs=_S, returns=_S,
           confidence=_S, calls=_AS)
COMPONENT = _st(module=_S, title=_S, summary=_S, symbols=_AS)
REPO_MAP = _st(repo=_S, root=_S, model=_S, total_symbols=T.LongType(),
               total_edges=T.LongType(), entry_points=_AS,
               components=T.ArrayType(COMPONENT), notes=T.ArrayType(NOTE))

ISSUE = _st(kind=_S, severity=_S, subject=_S, detail=_S, quote=_S)
REVIEW = _st(section_key=_S, heading=_S, passed=_B, claims_checked=T.LongType(),
             issues=T.ArrayType(ISSUE))

PACKAGE = _st(name=_S, summary=_S, license=_S, home=_S, requires=_AS, relevance=_D, _v=_I)

PURPOSE_REPLY = _st(purpose=_S, inputs=_S, returns=_S, confidence=_S)
COMPONENT_REPLY = _st(title=_S, summary=_S)
ANSWER_REPLY = _st(answer=_S, coverage=_S)
ALTERNATIVES_REPLY = _st(alternatives=T.ArrayType(_st(dependency=_S, does=_S, substitutes=_AS)))
