"""folioforge: bibliographic metadata at cluster scale, declared as Spark plans."""
