"""ledgerlens: sales analytics as Spark DataFrame plans.

Layout
------
functions/  Column expressions (text keys, lenient numbers, day-first dates, stats).
sources/    Table loading, the fixture views, CSV and report-export readers, sinks.
operators/  DataFrame -> DataFrame analytics (cleaning, integration, metrics,
            time series, distribution, Pareto, facets, catalog, forecast, report).
plans/      Named queries over a table folder and their DuckDB oracle SQL.
llm/        Operators on text corpora (imported by nothing else here).

Every public operator takes DataFrames and column names and returns a lazy
DataFrame.  The few that must look at data to decide a plan (column profiling,
role detection by content, header recovery) say so in their docstring and run
exactly one small aggregate job.
"""

__all__ = ["session"]
