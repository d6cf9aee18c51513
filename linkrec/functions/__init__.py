"""SQL expressions: relation masks, profile comparisons, id hashing."""
