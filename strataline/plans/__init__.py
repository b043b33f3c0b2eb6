"""Plans: pipelines and rule runs built of operators."""
