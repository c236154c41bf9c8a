"""Declared schemas; nested inputs are never inferred."""

from pyspark.sql import types as T

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MESSAGE = struct(role=S, content=S)
MESSAGES = T.ArrayType(MESSAGE)
TEXT = struct(text=S)
CONVERSATION = struct(messages=MESSAGES, source=S)
MULTIPLE_CHOICE_CONVERSATION = struct(messages=MESSAGES, source=S, subject=S)
CODE_COMPLETION = struct(task_id=S, prompt=S, canonical_solution=S, entry_point=S, test=S)
CODE_PROBLEM = struct(text=S, code=S, test_list=T.ArrayType(S), source=S)
PREFERENCE_PAIR = struct(chosen=MESSAGES, rejected=MESSAGES, source=S)
RAW_CONVERSATION = struct(system=S, messages=T.ArrayType(T.ArrayType(S)))
CALCULATOR_ITEM = T.StructType([*(T.StructField(c, S) for c in ("question", "response", "expected_output")), T.StructField("has_error", T.BooleanType()), T.StructField("problem_type", S), T.StructField("calculator_code", S)])
EVAL_ITEM = struct(query=S, choices=T.ArrayType(S), gold=I, context_options=T.ArrayType(S), continuation=S, context=S)
BASELINE = T.StructType([T.StructField("Eval Task", S), T.StructField("Random baseline", D)])
TOKEN_LOSS = struct(example_id=L, option=I, pos=I, loss=D, pred=I, actual=I)
