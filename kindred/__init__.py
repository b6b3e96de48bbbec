"""Record linkage on Spark: several noisy sources of business records, and for each record of the first its matches in the others."""
