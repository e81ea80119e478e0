"""glyphsieve: character-encoding forensics over large corpora, Spark first."""
