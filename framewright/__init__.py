"""framewright: declare survey-sampling plans and execute them on Spark."""
