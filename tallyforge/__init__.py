"""tallyforge: Spark jobs that turn untidy periodic reports into checked fact tables."""
