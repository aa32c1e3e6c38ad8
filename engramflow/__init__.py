"""engramflow: an associative-retrieval and evidence-analytics engine on Spark DataFrames."""
