"""Schemas and fixed values of an index."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T

SCHEMA_VERSION = 4


class Status(IntEnum):
    PENDING = 0
    INDEXED = 1
    FAILED_TRANSIENT = 2
    DELETED = 3
    FAILED_PERMANENT = 4
    SKIPPED = 5


class ExitCode(IntEnum):
    OK = 0
    OTHER = 1
    INDEX_NOT_FOUND = 3
    CONNECTION = 4
    VERSION = 5
    SCHEMA = 6
    NO_RESULTS = 7
    CONFIG = 78
    INTERRUPTED = 130


class IndexError_(Exception):
    """An error of the index with the exit code that a command would end with."""

    def __init__(self, message: str, code: ExitCode = ExitCode.OTHER):
        super().__init__(message)
        self.code = code


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(), "double": T.DoubleType(), "strings": T.ArrayType(T.StringType()), "ints": T.ArrayType(T.IntegerType()), "doubles": T.ArrayType(T.DoubleType()), "boolean": T.BooleanType()}


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[t], True) for n, t in (p.split() for p in text.split(","))])


#: Paths are bytes; `path` is their lossy display form and `path_raw` the key where they differ.
MANIFEST = _struct(
    "file_id long,path string,path_raw binary,path_hash long,inode long,dev long,size long,mtime_ns long,ctime_ns long,mode long,uid long,gid long,"
    "content_hash string,mime_type string,status int,fail_count int,first_seen_ns long,last_verified_ns long,error_msg string,hard_link_of long,parent_archive_id long"
)
WALK = _struct("path string,path_raw binary,size long,mtime_ns long,ctime_ns long,inode long,dev long,mode long,uid long,gid long,is_dir boolean")
PROGRESS = _struct("file_id long,index_name string,schema_ver int,indexed_at_ns long")
RUNS = _struct("run_id long,started_ns long,completed_ns long,kind string,method string,total_files long,new_files long,modified long,deleted long,unchanged long,processed long,duration_ms long,timed_out int,error string")
CHUNKS = _struct("file_id long,chunk_ord int,byte_start long,byte_end long,block_kind string,text string")
DOC_META = _struct("file_id long,title string,author string,subject string,creator string,producer string,created_at string,modified_at string,page_count int,word_count int,lang string")
MEDIA_META = _struct("file_id long,codec string,width int,height int,camera_make string,camera_model string,taken_at string,iso string,focal_length string,aperture string")
#: Of each indexed file: its chunks and the terms of their fields.
ENTRIES = _struct("file_id long,chunks long,body long,title long,path long")
ARCHIVE_META = _struct("file_id long,member_count long,total_size long,format string,extraction_status string")
LANGUAGES = _struct("lang string,gram string,n long,total long")
TAGS = _struct("file_id long,tag string")
#: part: folder of a segment, by the hash of the term.
POSTINGS = _struct("file_id long,chunk_ord int,field string,term string,length long,tf long,positions ints,part string")
BOUNDS = _struct("term string,field string,block long,n long,max_tf long,min_length long")
LENGTHS = _struct("n long,field string,average double")
#: Vectors of chunks as 16-bit floats, with their inverted list and the codes of what they lack from its centroid.
VECTORS = _struct("file_id long,chunk_ord int,list int,codes binary,half binary")
QUANTIZER = T.StructType([T.StructField("kind", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("values", T.ArrayType(T.FloatType()))])
