"""Small fixed prompt suites for looking at a model's answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COMPLETIONS = ["The river rises in the hills and", "Bread is made from flour,", "On a clear night you can see", "To open the window, first", "The opposite of heavy is"]
KNOWLEDGE = [("How many days has a week?", "seven"), ("Which planet do we live on?", "Earth"), ("What is two plus three?", "five"), ("What do bees make?", "honey")]
CONVERSATIONS = [[("user", "Good morning."), ("assistant", "Good morning! What can I do for you?"), ("user", "Name three colours.")], [("system", "Answer in one word."), ("user", "Is ice cold?")]]


def completions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in COMPLETIONS], "prompt string")


def knowledge(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWLEDGE, "question string, answer string")


def conversations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in CONVERSATIONS], "messages array<struct<role:string,content:string>>")
