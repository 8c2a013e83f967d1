"""Explicit schemas of the code model. No schema is ever inferred."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

S, I, L, B, D = StringType(), IntegerType(), LongType(), BooleanType(), DoubleType()


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields.items()])


IMPORT = _struct(alias=S, source=S)
ROUTE = _struct(method=S, path=S, handlers=ArrayType(S))
FUNCTION = _struct(
    file_path=S, function_name=S, language=S, start_line=I, end_line=I, start_byte=L, end_byte=L, pos=I, line_count=I, code=S,
    calls=ArrayType(_struct(pos=I, raw_call=S)),
)
NODE = _struct(
    id=S, function_name=S, file_path=S, callers=ArrayType(S), callees=ArrayType(S), is_entry_point=B, is_infrastructure=B, is_external=B,
    is_taint_source=B, is_taint_sink=B,
)
REPORT = _struct(
    function_name=S, file_path=S, language=S, vulnerability_found=B, cwe_id=S, affected_lines=ArrayType(I), severity=S, explanation=S,
    patch_suggestion=S, confidence=D, hallucination_flag=B, analysis_mode=S, error=S,
)
STEP = _struct(is_final=B, report=REPORT, tool_name=S, tool_args=MapType(S, S), reasoning=S)
RUN = _struct(
    run_id=S, model=S, source_path=S,
    findings=ArrayType(_struct(function_name=S, file_path=S, language=S, vulnerability_found=B, cwe_id=S, affected_lines=ArrayType(I), severity=S,
                               explanation=S, patch_suggestion=S, confidence=D, hallucination_flag=B, analysis_mode=S, error=S)),
)
GROUND_TRUTH = _struct(
    dataset=S, description=S, source_path=S,
    functions=ArrayType(_struct(function_name=S, file=S, vulnerable=B, cwe_id=S, severity=S, affected_lines=ArrayType(I), notes=S, duplicate_of=S)),
)
PATCH_RESULT = _struct(valid=B, patched_code=S, error=S)
EDGE_CACHE = _struct(key=S, target=S, confidence=D, reasoning=S, resolved_by=S)
