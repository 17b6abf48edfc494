"""DataFrame operators: chunking, search, fusion, joins, prompts, evaluation."""
