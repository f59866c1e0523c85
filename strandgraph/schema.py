"""Explicit schemas of the topology tables.

``nodes`` is one wide table discriminated by ``type``; ``edges`` holds at most
one row for each (type, source, target, provenance of the id).  Readers use
these types and never infer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_TYPES = ("ServiceNode", "DatabaseNode", "ConfigNode", "InfraNode", "FrontierNode", "FileNode", "RouteNode", "GraphQLOperationNode", "GrpcMethodNode", "WebSocketChannelNode", "SymbolNode", "ServerActionNode")
EDGE_TYPES = ("CALLS", "DEPENDS_ON", "CONNECTS_TO", "CONFIGURED_BY", "PUBLISHES_TO", "CONSUMES_FROM", "RUNS_ON", "CONTAINS", "IMPORTS", "INHERITS", "IMPLEMENTS", "REFERENCES")
PROVENANCES = ("EXTRACTED", "INFERRED", "OBSERVED", "STALE")

_COLUMN = "struct<name:string,provenances:array<string>,confidence:double,sdkWrites:array<string>>"
_INCOMPATIBILITY = "struct<kind:string,driver:string,driverVersion:string,engine:string,engineVersion:string,package:string,packageVersion:string,requiredNodeVersion:string,declaredNodeEngine:string,requires:struct<name:string,minVersion:string>,foundVersion:string,reason:string>"



_SCALARS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _parts(text: str) -> list[str]:
    """Split at commas outside of angle brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


def _type(text: str) -> T.DataType:
    text = text.strip()
    head, _, inner = text.partition("<")
    inner = inner[:-1]
    if head == "array":
        return T.ArrayType(_type(inner))
    if head == "map":
        key, value = _parts(inner)
        return T.MapType(_type(key), _type(value))
    if head == "struct":
        return T.StructType([T.StructField(*((x := f.strip().partition(":"))[0], _type(x[2]))) for f in _parts(inner)])
    return _SCALARS[head]


def struct(ddl: str) -> T.StructType:
    """A schema from ``name type, ...``; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(f.strip().split(" ", 1)[0], _type(f.strip().split(" ", 1)[1])) for f in _parts(ddl)])


NODES = struct(
    "id string, type string, name string, service string, language string, env string, framework string, platform string, platformName string,"
    " discoveredVia string, version string, dbConnectionTarget string, repoPath string, owner string, dependencies map<string,string>,"
    f" aliases array<string>, nodeEngine string, incompatibilities array<{_INCOMPATIBILITY}>, engine string, engineVersion string,"
    " compatibleDrivers array<struct<name:string,minVersion:string>>, host string, port int, path string, fileType string, provider string,"
    f" region string, kind string, columns array<{_COLUMN}>, guardedFields array<string>, firstObserved timestamp, lastObserved timestamp,"
    " originalPath string, method string, pathTemplate string, operationType string, operationName string, rpcService string, rpcMethod string,"
    " channel string, qualname string, relPath string, module string, exportName string, line int, span struct<startLine:int,endLine:int>"
)
EDGES = struct(
    "id string, source string, target string, type string, provenance string, confidence double, lastObserved timestamp, callCount bigint,"
    " evidence struct<file:string,line:int,snippet:string,method:string,pathTemplate:string,hostSource:string>,"
    " signal struct<spanCount:bigint,errorCount:bigint,lastObservedAgeMs:double,latencyMs:struct<p50:double,p95:double>,latencyHist:map<int,bigint>,anomalous:boolean>,"
    " grain string"
)
SPANS = struct(
    "service string, env string, traceId string, spanId string, parentSpanId string, name string, kind int, startTimeUnixNano bigint, durationNanos bigint,"
    " statusCode int, attributes map<string,string>, exception struct<type:string,message:string,stacktrace:string>, resourceServiceNamePresent boolean,"
    " dbSystem string, dbName string, dbStatement string, dbTable string, dbColumns array<string>, httpRoute string, httpMethod string, messagingSystem string, messagingDestination string,"
    " graphqlOperationName string, graphqlOperationType string, rpcSystem string, rpcService string, rpcMethod string, websocketChannel string"
)
INCIDENTS = struct(
    "id string, timestamp string, service string, traceId string, spanId string, errorType string, errorMessage string, exceptionType string,"
    " exceptionStacktrace string, attributes map<string,string>, affectedNode string, httpStatusCode int, incidentCount int, firstTimestamp string, lastTimestamp string"
)
STALE_EVENTS = struct("edgeId string, source string, target string, edgeType string, thresholdMs bigint, ageMs bigint, lastObserved string, transitionedAt string")
LOGS = struct("id string, projectName string, source string, serviceName string, nodeId string, timestamp string, severity string, message string, attributes map<string,string>")
SIGNALS = struct(
    "targetKind string, targetName string, method string, path string, callCount bigint, errorCount bigint, lastObservedIso string,"
    " callSite struct<file:string,line:int>, columns array<string>, incident struct<errorType:string,errorMessage:string,id:string>"
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of a schema; missing ones are null."""
    have = {*df.columns}
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def table(spark: SparkSession, schema: T.StructType, rows: list[dict]) -> DataFrame:
    """A small table from dictionaries; absent fields are null."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
