"""Schemas of the graph's tables and its fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relation labels in their order, and the weight by which one of several
#: relations between two types is the dominant one.
RELATIONS = [
    ("inherits", 0, 2),
    ("implements", 1, 2),
    ("ctor-param", 2, 4),
    ("field", 3, 3),
    ("property", 4, 3),
    ("new", 5, 5),
    ("call", 6, 7),
    ("sends", 7, 6),
    ("handled-by", 8, 6),
    ("di-bound", 9, 1),
    ("returns", 10, 1),
    ("param", 11, 1),
]
#: Label of a relation without a known name.
OTHER_RELATION = "uses"
#: Relations that carry a message from one type to another.
MESSAGE_RELATIONS = ("sends", "handled-by")

_STEP = "array<struct<kind:string,name:string,ns:string,type_simple_name:string>>"
#: One row per file: the unit of incremental work.
FRAGMENT_DDL = (
    "file_path string, hash string, usings array<string>, aliases map<string,string>, "
    "nodes array<struct<name:string,namespace:string,kind:string,is_public:boolean,start_line:int,end_line:int,summary:string>>, "
    "edges array<struct<from_type:string,from_resolved:boolean,to_type:string,to_resolved:boolean,ns:string,relation:string,line:int,from_member:string>>, "
    "endpoints array<struct<type_name:string,verb:string,route:string,method_name:string,line:int>>, "
    "call_sites array<struct<caller_type:string,caller_member:string,callee_type:string,callee_member:string,ns:string,line:int>>, "
    "di_bindings array<struct<service_type:string,implementation_type:string,lifetime:string,ns:string,line:int>>, "
    "members array<struct<type_name:string,member_name:string,kind:string,signature:string,start_line:int,end_line:int,is_public:boolean>>, "
    "return_sigs array<struct<type_name:string,member_name:string,kind:string,return_simple_type:string,ns:string>>, "
    f"pending_calls array<struct<caller_type:string,caller_member:string,callee_member:string,receiver:{_STEP},ns:string,line:int>>, "
    f"pending_locals array<struct<declaring_type:string,declaring_member:string,local_name:string,initializer:{_STEP},ns:string>>, failed boolean"
)
#: Version of the extraction; fragments of another version are not read.
PARSER_VERSION = 2


def relation_order(label: Column) -> Column:
    """Position of a label in the fixed order; unknown labels come last."""
    out = F.lit(len(RELATIONS))
    for name, order, _ in RELATIONS:
        out = F.when(label == name, order).otherwise(out)
    return out


def relation_weight(label: Column) -> Column:
    """Weight of a label when the dominant relation is chosen."""
    out = F.lit(1)
    for name, _, weight in RELATIONS:
        out = F.when(label == name, weight).otherwise(out)
    return out


def relation_dim(spark: SparkSession) -> DataFrame:
    """The vocabulary as a table of twelve rows."""
    return spark.createDataFrame(RELATIONS, "relation string, ordinal int, weight int")


def is_test_double(key: Column) -> Column:
    """Whether the last segment of an upper-case name looks like a test or its stand-in."""
    return F.substring_index(key, ".", -1).rlike("(TESTS?$|MOCK|FAKE|STUB|BUILDER)")
