"""Table layouts that all operators share."""

MANIFEST = ("tile_id string, place string, terrain string, mask_path string, image_path string, crs string, west double, south double, east double,"
            " north double, width int, height int, resolution_m double, road_frac double, split string")
CELL = "tile_id string, row int, col int"
TILE = "tile_id string, height int, width int, data binary"
NODES = "graph_id string, node_id long, x double, y double"
EDGES = "graph_id string, src long, dst long, length double"
PATHS = "graph_id string, source long, target long, distance double"
