"""Operators on tables of observations: DataFrame -> DataFrame, for use with DataFrame.transform."""
