"""Schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

DETECTIONS = "video_id long, frame_id long, det_idx long, class_id long, confidence double, x1 long, y1 long, x2 long, y2 long"
POSES = "video_id long, frame_id long, pose_idx int, bbox array<double>, keypoints array<struct<x:double,y:double,c:double>>, confidence double"
OCR_VOTES = "video_id long, frame_id long, det_idx int, variant int, text string, conf double"
BALL_CANDIDATES = "video_id long, frame_id long, cand_idx int, x double, y double, score double"
HOMOGRAPHIES = "video_id long, frame_id long, h array<double>"
SHOT_LABELS = "video_id long, frame_id long, label int"
EMBEDDINGS = "video_id long, frame_id long, det_idx int, color array<float>, reid array<float>"
VIDEO_META = "video_id long, fps double, width int, height int, total_frames int"
SEGMENTS = "video_id long, seg_idx int, start_frame long, end_frame long, player_id long"
PASSES = "video_id long, frame_start long, frame_end long, from_player long, to_player long, team_id long"
SHOTS = "video_id long, shot_idx int, start_frame long, end_frame long, is_make boolean, make_start long, make_end long"
MOT_YOLO = "frame_id int, track_id int, class_id int, cx double, cy double, w double, h double"
MOT_CSV = "frame_id int, class_id int, bbox_x_min int, bbox_y_min int, bbox_x_max int, bbox_y_max int, skip1 string, skip2 string, skip3 string, skip4 string, field_x double, field_y double"
JOBS = "id string, status string, video_name string, display_name string, created_at string, error string"
COMMENTS = "id int, job_id string, timestamp_sec double, text string, created_at string"
COURT_KEYPOINTS = "video_path string, video_file string, frames array<struct<physical_frame:int,logical_frame:int,width:int,height:int,keypoints_xy:array<array<double>>,homography:array<array<double>>>>"
SHOT_ANNOTATIONS = "updated_at string, annotations array<struct<clip_path:string,status:string,start_frame:int,finish_frame:int,shot_start_frame:int,shot_end_frame:int,make_start_frame:int,make_end_frame:int,fps:double,total_frames:int,updated_at:string>>"
TEAM_GT = "image_path string, bboxes array<array<int>>, team_labels array<string>"
