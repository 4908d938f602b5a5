"""All queries and their SQL, the llm subpackage's aside."""

from __future__ import annotations

from . import answers, drafting, drafts, evaluation, exports, navigation, reviewing, runs, search, text

QUERIES = text.QUERIES | answers.QUERIES | search.QUERIES | runs.QUERIES | drafts.QUERIES | drafting.QUERIES | evaluation.QUERIES | exports.QUERIES | navigation.QUERIES | reviewing.QUERIES
SQL = text.SQL | answers.SQL | search.SQL | runs.SQL | drafts.SQL | drafting.SQL | evaluation.SQL | exports.SQL | navigation.SQL | reviewing.SQL
