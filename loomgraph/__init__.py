"""loomgraph: facts about code and documentation as Spark DataFrames.

Every operator is a function from DataFrames to DataFrames.  Nothing in the
core imports the subpackage ``llm``.
"""
