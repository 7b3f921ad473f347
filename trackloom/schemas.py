"""Column groups and types of the measurement tables."""

#: Names and order of the columns, landmarks, keypoints and skeleton edges.
LANDMARKS = ["left_eye", "right_eye", "nose", "mouth_left", "mouth_right"]
KEYPOINTS = [
    "nose",
    "left_eye",
    "right_eye",
    "left_ear",
    "right_ear",
    "left_shoulder",
    "right_shoulder",
    "left_elbow",
    "right_elbow",
    "left_wrist",
    "right_wrist",
    "left_hip",
    "right_hip",
    "left_knee",
    "right_knee",
    "left_ankle",
    "right_ankle",
]
SKELETON = [(5, 7), (7, 9), (6, 8), (8, 10), (5, 6), (5, 11), (6, 12), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16), (0, 1), (0, 2), (1, 3), (2, 4)]

CORNERS = ["x1", "y1", "x2", "y2"]
TRACK_COLUMNS = ["frame", "track_id", *CORNERS, "conf"]
FACE_COLUMNS = ["face_score", *(f"face_{c}" for c in CORNERS), *(f"{p}_{a}" for p in LANDMARKS for a in "xy")]
POSE_COLUMNS = ["pose_score", *(f"pose_{c}" for c in CORNERS), *(f"pose_{p}_{a}" for p in KEYPOINTS for a in ("x", "y", "score"))]
KEYS = ["input_id", "frame", "track_id"]

BOX = "struct<x1:double,y1:double,x2:double,y2:double,track_id:bigint>"
FACE = f"struct<box:{BOX},score:double,landmarks:array<struct<x:double,y:double>>,embedding:array<float>>"
POSE = f"struct<box:{BOX},score:double,keypoints:array<struct<x:double,y:double,score:double>>>"
RAW_TRACKS = "frame_idx bigint, tracks array<array<double>>, embeddings array<array<float>>"
RAW_FACES = f"frame_idx bigint, faces array<{FACE}>"
RAW_POSES = f"frame_idx bigint, poses array<{POSE}>"
EMBEDDINGS = "track_id bigint, frame bigint, score float, embedding array<float>"
#: How a half-precision vector is stored by other writers: two little-endian bytes an element.
EMBEDDINGS_HALF = "track_id bigint, frame bigint, score float, embedding array<binary>"
GAZE = "participant bigint, rectimestamp double, gaze_x double, gaze_y double, pupil_left double, pupil_right double, gaze_video_time double"

#: Frames of raw recordings are stored in folders of this many each, by the column FRAME_BUCKET.
FRAMES_A_BUCKET, FRAME_BUCKET = 1000, "frame_bucket"
