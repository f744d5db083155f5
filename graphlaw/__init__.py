"""graphlaw: a property-graph query, rule and law engine on Spark DataFrames."""
