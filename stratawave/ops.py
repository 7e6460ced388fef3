"""All operators under one name each.

Eager and lazy forms of an operator are one thing here, since every DataFrame is lazy: a
builder (``TopicPipeline``, ``DatasetQuery``, ``SourcePipeline``) and the function of the
same purpose share one implementation.
"""

from __future__ import annotations

from stratawave.functions.camera import (  # noqa: F401
    CameraModel, backproject_pixels, camera_matrix, camera_model, crop_camera_matrix, distort_normalized_points, distort_pixels, normalized_points_to_pixels,
    pixels_to_normalized_points, project_camera_points, project_points_to_image, scale_camera_matrix, undistort_normalized_points, undistort_pixels,
)
from stratawave.functions.geodesy import enu_to_navsat, enu_to_ned, geographic_bounds_mask, local_to_navsat, navsat_to_enu, navsat_to_ned, ned_to_enu, ned_to_navsat  # noqa: F401
from stratawave.functions.masks import bounds_mask, crop_bounds, crop_geographic_bounds, crop_oriented_bounds, oriented_bounds_mask, select_mask  # noqa: F401
from stratawave.functions.quaternion import (  # noqa: F401
    compensate_gravity, compensate_imu_gravity, euler_to_quaternion, normalize_quaternion, quaternion_to_euler, quaternion_to_rotation_matrix, rotate_vectors_by_quaternion, slerp,
)
from stratawave.functions.transforms import (  # noqa: F401
    FrameGraph, apply_transform, dem_grid_to_points, pose_to_matrix, poses_to_matrices, transform_dem_grid, transform_navsat, transform_odometry, transform_poses, transform_vectors,
)
from stratawave.operators.align import align_backward, align_bounded, align_exact, align_nearest, align_topic, nearest_time_index, nearest_topic_pairs, resample_topic, rolling_window_join  # noqa: F401
from stratawave.operators.image import (  # noqa: F401
    align_image, align_images, apply_image_mask, close_mask, colorize_points, convert_color, convert_image_dtype, crop_image, crop_images, depth_to_normals, depth_to_point_grid, depth_to_points,
    dilate_mask, erode_mask, estimate_image_shift, fft_filter, frame_optical_flow, frame_to_frame_optical_flow, fuse_rgbd_frames, image_gradients, image_mask, image_pyramid, iter_aligned_images,
    iter_frame_optical_flow, iter_motion_compensated_windows, iter_rgbd_frame_points, local_mean, local_statistics, local_std, motion_compensated_rolling_windows, normalize_image, normalize_images,
    open_mask, pad_image, pad_images, points_to_depth_image, project_dem_to_image, rectification_map, rectify_image, resize_images, resize_images_nearest, resize_nearest, rgb_to_gray, rgbd_to_points,
    sample_image_at_pixels, sample_image_at_points, threshold_image, translate_image, valid_depth_mask,
)
from stratawave.operators.ml import (  # noqa: F401
    IteratorDataset, NumpyDataset, augment_dem_patch, augment_image, augment_point_cloud, augment_trajectory, collate, collate_samples, deterministic_split_indices, split_topic, to_iterator_dataset, to_numpy_dataset, to_torch_dataset,
)
from stratawave.operators.points import (  # noqa: F401
    apply_depth_metric_scale, apply_point_cloud_metric_scale, calibrate_depth_anything_point_cloud, calibrate_depth_metric_scale, calibrate_point_cloud_metric_scale, cluster_dbscan, connected_components,
    curvature_descriptors, estimate_normals, explode_points, farthest_point_downsample, find_loop_closure_candidates, hybrid_search, iter_loop_closure_candidates, knn_search, local_covariances,
    nearest_neighbor_distance_stats, nearest_neighbor_distances, radius_outlier_filter, radius_search, random_downsample, segment_ground, segment_plane, statistical_outlier_filter, uniform_downsample,
    valid_point_cloud_points, voxel_downsample,
)
from stratawave.operators.raster import (  # noqa: F401
    crop_raster, dem_to_mesh, dem_to_point_cloud, hillshade, mosaic_dem_tiles, mosaic_tiles, read_dem_cache, reproject_raster, resample_raster, roughness_map, sample_elevation, sample_elevation_at_navsat, sample_grid,
    slope_aspect, terrain_gradients, terrain_normals, terrain_patch, terrain_patch_at_navsat, traversability_map, write_dem_cache,
)
from stratawave.operators.registration import multi_scale_icp, odometry_seeded_icp, point_to_plane_icp, point_to_point_icp, verify_loop_closures  # noqa: F401
from stratawave.operators.summary import correct_bias, describe_dataset, describe_topic, estimate_bias, format_describe  # noqa: F401
from stratawave.operators.topic import Dataset, Topic, dataset_query, filter_topic, iter_chunks, map_topic, reduce_topic, select_indices, select_time_range, topic_parts, topic_pipeline, topic_arrays, topic_view, TopicArrays  # noqa: F401
from stratawave.operators.trajectory import (  # noqa: F401
    add_trajectory_quality_mask, angular_velocity_from_quaternions, correct_imu_bias, dead_reckon_trajectory, differentiate_trajectory, imu_to_trajectory, integrate_orientations, integrate_trajectory,
    interpolate_quaternions, interpolate_timeseries, interpolate_trajectory, mask_trajectory, navsat_to_local, navsat_to_trajectory, odometry_to_trajectory, propagate_trajectory_covariance, read_tum_trajectory,
    resample_imu, resample_navsat, resample_odometry, resample_trajectory, sensor_to_trajectory, smooth_trajectory, to_tum_trajectory, trajectory_quality_mask, write_kitti_trajectory, write_tum_trajectory,
)
from stratawave.operators.windows import differentiate_timeseries, integrate_timeseries, iter_ml_windows, smooth_timeseries, trajectory_speed, window_topic  # noqa: F401
from stratawave.schema import topic_metadata  # noqa: F401
from stratawave.sources.export import from_open3d_point_cloud, load_topic_npz, save_topic_npz, to_open3d_point_cloud, write_html  # noqa: F401
from stratawave.sources.messages import decode_depth_anything_calibration, decode_image, decode_imu, decode_navsatfix, decode_odometry, decode_pointcloud2, decode_pose_stamped, decode_rosbridge_json_message, decode_supported_cdr_message, pointcloud_xyz  # noqa: F401
from stratawave.sources.sources import data_source, synthetic  # noqa: F401
from stratawave.sources.store import DataBuffer, Store  # noqa: F401
from stratawave.streaming.source import CancellationToken, PipelineCancelled, PipelineProgress, SourcePipeline, source_pipeline  # noqa: F401

TopicPipeline, DatasetQuery, DataSources, SyntheticSource, TopicWindowPipeline, TopicMetadata, TopicView = Topic, Dataset, data_source, synthetic, window_topic, topic_metadata, TopicArrays
