"""Set-at-a-time analytics of a package ecosystem, and of training data, on Spark."""
