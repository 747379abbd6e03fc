"""folioforge: document and change analytics on Spark.

Packages, parts, markup tags, paragraphs, node rows, styles, revisions, grids,
candidates, decisions and review events are DataFrames; every operator is a
function from DataFrames to a DataFrame over whole corpora.
"""
