"""Schemas of messages, results and side tables, as DDL."""

MESSAGE = "jobId string, file string, timestamp string, clientId string, metadata struct<coordinatesX: double, coordinatesY: double>"
PITH = "Image string, cx double, cy double"
CENTRE = "codigo_imagen string, x int, y int"
RING_COUNTS = "image_code string, rings_count int"
ANNOTATION = "shapes array<struct<points: array<array<double>>>>"
IMAGE_FILE = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
RESULT = "jobId string, clientId string, status string, timestamp string, data string, error string, corrupt string"
