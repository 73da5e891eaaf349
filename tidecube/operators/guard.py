"""Read-only SQL: what a text may be, what its plan may do, and running it with a row cap.

A text is looked at twice. is_read_only reads it as text and turns down what is plainly no single query. What counts is the
second look: Spark analyses the text in a session of its own that knows nothing but the tables that are given, and every node
and expression of the analysed plan must be on the lists below. What is not on them is refused, whatever it is called and
however its name was put together.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

WORDS = re.compile(r"\b(drop|delete|insert|update|alter|create|attach|copy|pragma|set|truncate|merge|replace\s+table|grant|revoke)\b", re.I)
#: What is no SQL of its own, from left to right as Spark reads it: raw texts, texts, quoted names, comments.
OTHER = re.compile(r"""(?P<text>\br'[^']*'|\br"[^"]*"|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")|(?P<name>`(?:[^`]|``)*`)|--[^\r\n]*|/\*.*?\*/""", re.S | re.I)
#: Functions that call any static method of the JVM.
CALLS = re.compile(r"\b(?:java_method|(?:try_)?reflect)\W*\(", re.I)
#: A file as a table: format.`path`.
FILES = re.compile(r"(?:\w|`)\s*\.\s*`[^`]*[/\\:]|\b(?:parquet|orc|csv|json|text|avro|xml|binaryfile|image|libsvm|delta|iceberg)`?\s*\.\s*`", re.I)
#: A script that rows are sent through.
SCRIPT = re.compile(r"\busing\s*''", re.I)
FENCE = re.compile(r"```(?:sql)?\s*\n?(.*?)```", re.S | re.I)


def is_read_only(sql: str) -> bool:
    """One SELECT or WITH statement without a word that changes anything, without calls into the JVM, files as tables and
    scripts. Words in strings, comments and quoted names do not count."""
    text = (sql or "").strip()
    text = text[:-1].rstrip() if text.endswith(";") else text
    named = OTHER.sub(lambda m: "''" if m["text"] else m["name"] or " ", text)
    if CALLS.search(named) or FILES.search(named):
        return False
    bare = OTHER.sub(lambda m: "''" if m["text"] else " q " if m["name"] else " ", text).strip()
    return bool(re.match(r"(select|with)\b", bare, re.I)) and ";" not in bare and not WORDS.search(bare) and not SCRIPT.search(bare)


#: Steps that a plan may have. Its tables are views; a plan's other leaves are rows that stand in the text.
NODES = """
Aggregate CTERelationDef CTERelationRef Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Project
ResolvedHint Sample Sort SubqueryAlias Union Window WithCTE
""".split()
#: Expressions that a plan may have, apart from aggregates: names, literals, comparisons and subqueries first.
EXPRESSIONS = """
Alias And AttributeReference Between CaseWhen Cast Coalesce CommonExpressionDef CommonExpressionRef EqualNullSafe EqualTo Exists GreaterThan GreaterThanOrEqual Greatest If In InSubquery IsNaN IsNotNull IsNull
KnownNullable LateralSubquery Least LessThan LessThanOrEqual ListQuery Literal NaNvl Not NullIf Nvl Nvl2 Or OuterReference ScalarSubquery SortOrder TypedNullLiteral With
Abs Add BRound Cbrt Ceil Divide Exp Floor IntegralDivide Log Log10 Log1p Log2 Logarithm Multiply Pmod Pow Rand Remainder Round RoundCeil RoundFloor Signum Sqrt Subtract TryAdd TryDivide UnaryMinus UnaryPositive WidthBucket
Ascii Chr Concat ConcatWs Contains EndsWith FormatNumber FormatString ILike InitCap Left Length Like Lower RLike RegExpExtract RegExpReplace Reverse Right SplitPart StartsWith StringInstr StringLPad StringLocate StringRPad
StringReplace StringSplit StringTranslate StringTrim StringTrimLeft StringTrimRight Substring Upper
AddMonths CurrentDate CurrentTimestamp DateAdd DateDiff DateFormatClass DateSub DatetimeSub DayName DayOfMonth DayOfWeek DayOfYear Extract FromUnixTime Hour LastDay MakeDate MakeTimestamp Minute Month MonthName MonthsBetween
NextDay Now ParseToDate ParseToTimestamp PreciseTimestampConversion Quarter Second SecondsToTimestamp SubtractDates SubtractTimestamps TimestampAdd TimestampAddInterval TimestampDiff TruncDate TruncTimestamp UnixTimestamp WeekDay
WeekOfYear Year
ArrayContains ArrayDistinct ArrayJoin ArrayMax ArrayMin ArraySort ArrayTransform CreateArray CreateMap CreateNamedStruct ElementAt Explode Get GetArrayItem GetMapValue GetStructField LambdaFunction MapKeys MapValues
NamedLambdaVariable PosExplode Size Slice SortArray
CumeDist CurrentRow$ DenseRank Lag Lead NTile NthValue PercentRank Rank RowNumber SpecifiedWindowFrame UnboundedFollowing$ UnboundedPreceding$ WindowExpression WindowSpecDefinition
""".split()
AGGREGATES = """
AggregateExpression AnyValue ApproximatePercentile Average BoolAnd BoolOr CollectList CollectSet Corr Count CountIf CovPopulation CovSample First HyperLogLogPlusPlus Kurtosis Last ListAgg Max MaxBy Median Min MinBy Mode Percentile
PercentileCont PercentileDisc PivotFirst RegrCount RegrIntercept RegrR2 RegrSlope Skewness StddevPop StddevSamp Sum VariancePop VarianceSamp
""".split()
CATALYST = "org.apache.spark.sql.catalyst"
ALLOWED = {f"{CATALYST}.plans.logical.{n}" for n in NODES} | {f"{CATALYST}.expressions.{n}" for n in EXPRESSIONS} | {f"{CATALYST}.expressions.aggregate.{n}" for n in AGGREGATES}
VIEW = f"{CATALYST}.plans.logical.View"


class Refused(ValueError):
    """Why a text is not run."""


def after(nodes: list[dict], i: int) -> int:
    """The place behind the tree that begins at i, of trees written node by node, each before its children."""
    left = 1
    while left:
        left += nodes[i]["num-children"] - 1
        i += 1
    return i


def strange(plan, tables: set[str]) -> Iterator[str]:
    """Names of what a plan has and may not have. A given table's view is a leaf, whatever it is made of."""
    if isinstance(plan, dict):
        if "class" in plan and plan["class"] not in ALLOWED:
            yield plan["class"].rpartition(".")[2].rstrip("$")
        for v in plan.values():
            yield from strange(v, tables)
    elif isinstance(plan, list):
        i = 0
        while i < len(plan):
            node = plan[i]
            if isinstance(node, dict) and node.get("class") == VIEW:
                name = node["desc"]["identifier"]
                if name["table"] in tables and "database" not in name:
                    i = after(plan, i)
                    continue
            yield from strange(node, tables)
            i += 1


def checked(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The query's DataFrame, not yet run, or Refused. tables are what it may read, by name; unset, the session's temporary
    views and the tables of its current database. The caller's session and its settings stay as they are."""
    if not is_read_only(sql):
        raise Refused("only a single SELECT statement is allowed")
    text = sql.strip().rstrip(";")
    if tables is None:
        tables = {t.name: spark.table(t.name if t.isTemporary else f"`{t.namespace[0]}`.`{t.name}`") for t in spark.catalog.listTables() if re.search(rf"\b{re.escape(t.name)}\b", text, re.I)}
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in tables.items():
        carrier = f"guarded_{uuid.uuid4().hex}"
        df.createGlobalTempView(carrier)
        own.table(f"global_temp.{carrier}").createOrReplaceTempView(name)
        spark.catalog.dropGlobalTempView(carrier)
    try:
        #: only a query can stand in brackets, and none of it runs while it is analysed
        plan = json.loads(own.sql(f"SELECT * FROM (\n{text}\n)")._jdf.queryExecution().analyzed().toJSON())
        found = sorted(set(strange(plan, {n.lower() for n in tables} | set(tables))))
        if found:
            raise Refused(f"not allowed: {', '.join(found)}")
        return own.sql(text)
    except PySparkException as e:
        raise Refused(str(e).strip().split("\n")[0]) from e


def run(spark: SparkSession, sql: str, most: int = 200, tables: dict[str, DataFrame] | None = None) -> dict:
    """{row_count, rows} with `most` rows at most, or {error}."""
    try:
        rows = [r.asDict() for r in checked(spark, sql, tables).limit(most).collect()]
    except (Refused, PySparkException) as e:  # what is wrong with the text goes back to who wrote it
        return {"error": str(e).strip().split("\n")[0]}
    return {"row_count": len(rows), "rows": rows}


def extract_sql(text: str) -> str:
    """The first fenced block, else the text from its first SELECT or WITH."""
    if m := FENCE.search(text):
        return m[1].strip()
    m = re.search(r"\b(select|with)\b", text, re.I)
    return text[m.start() :].strip() if m else ""
