"""Rows of question and code sets to conversations and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.messages import message

# Labels of choices, and what opens a question with choices.
LETTERS = "ABCD"
CHOICE_QUESTION = "Multiple Choice question: "


def question_answer(question: Column, answer: Column) -> Column:
    """User, assistant and an empty user that marks the turn's end."""
    return F.array(message(F.lit("user"), question), message(F.lit("assistant"), answer), message(F.lit("user"), F.lit("")))


def code_completion(prompt: Column, solution: Column) -> Column:
    return F.array(message(F.lit("user"), prompt), message(F.lit("assistant"), F.concat(prompt, solution)))


def answer_index(answer: Column) -> Column:
    """From a number or a letter A-D; anything else raises."""
    number = answer.cast("string").try_cast("int")
    letter = F.instr(F.lit(LETTERS), answer.cast("string")) - 1
    return F.when(number.isNotNull(), number).when((letter >= 0) & (F.length(answer.cast("string")) == 1), letter).otherwise(F.raise_error(F.concat(F.lit("no answer: "), answer.cast("string"))).cast("int"))


def multiple_choice(question: Column, choices: Column, answer: Column) -> Column:
    lines = F.transform(choices, lambda c, i: F.concat(F.lit("- "), c, F.lit("="), F.substring(F.lit(LETTERS), i + 1, F.lit(1))))
    text = F.concat(F.lit(CHOICE_QUESTION), question, F.lit("\n"), F.array_join(lines, "\n"))
    return question_answer(text, F.substring(F.lit(LETTERS), answer_index(answer) + 1, F.lit(1)))


def completion_prompt(prompt: Column, entry_point: Column, test: Column) -> Column:
    """struct<question, test_prefix, test_suffix> for a function to complete."""
    question = F.concat(F.lit("Complete the following Python function. Answer with a Python code block.\n\n```python\n"), prompt, F.lit("\n```"))
    return F.struct(question.alias("question"), prompt.alias("test_prefix"), F.concat(test, F.lit("\ncheck("), entry_point, F.lit(")")).alias("test_suffix"))


def problem_prompt(text: Column, tests: Column) -> Column:
    """struct<question, test_prefix, test_suffix> for a problem with tests."""
    question = F.concat(text, F.lit("\n\nAnswer with a Python code block. It has to pass:\n"), F.array_join(tests, "\n"))
    return F.struct(question.alias("question"), F.lit(None).cast("string").alias("test_prefix"), F.array_join(tests, "\n").alias("test_suffix"))


def solved_prompt(prompt: Column, solution: Column, entry_point: Column, test: Column) -> Column:
    """struct<question, test_code>: a function to complete, and a program that tests the given solution."""
    question = F.concat(F.lit("Write the rest of this Python function.\n\n"), prompt)
    return F.struct(question.alias("question"), F.concat(prompt, solution, F.lit("\n\n"), test, F.lit("\ncheck("), entry_point, F.lit(")")).alias("test_code"))
