"""Input side: schemas, CSV load layer, test-table mapping, load step."""
