"""The page-oriented query language: text -> syntax tree -> DataFrame."""
